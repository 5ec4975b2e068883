"""Saved models: the tree, its parameters and the history of its clusters, as a checked text file."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import os
import struct
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np

from ..config import ALGO_VERSION, LEVELS, MiningConfig, SettingError
from ..functions.masking import mask_fingerprint
from ..operators.tree import Tree

KIND, SCHEMA = "template-state", 2
#: First bytes of the binary form.
MAGIC = b"\x93template-state\x00"
MAX_BYTES, MAX_TEMPLATES, MAX_NODES, MAX_TOKEN_BYTES = 1 << 30, 1_000_000, 4_000_000, 64 << 10


@dataclass
class Model:
    """A finished tree with the counts of all the runs it has seen.

    ``history`` has [count, first, last, [records per level]] for each cluster,
    ``overflow`` the same for each message length beyond the cap.
    """

    config: MiningConfig
    tree: Tree
    history: list[list]
    overflow: dict[int, list] = field(default_factory=dict)
    format: str = "plain"


def empty_history() -> list:
    return [0, None, None, [0] * len(LEVELS)]


def absorb(history: list, count: int, first: int | None, last: int | None, levels: list[int]) -> list:
    """History with one more run."""
    some = lambda pick, *xs: pick([x for x in xs if x is not None], default=None)
    return [history[0] + count, some(min, history[1], first), some(max, history[2], last), [a + b for a, b in zip(history[3], levels, strict=True)]]


def dumps(model: Model) -> bytes:
    """Header, body and checksum, a line each."""
    config = model.config
    body = model.tree.to_rows()
    del body["births"]
    recency = getattr(model.tree, "recency", None)
    if config.on_full == "evict" and recency is not None:
        order = {c: r for r, c in enumerate(sorted(range(len(recency)), key=lambda c: (recency[c], c)))}
        body["recency"] = [order[c] for c in range(len(recency))]
    body |= {"history": model.history, "overflow": [[n, h] for n, h in sorted(model.overflow.items())]}
    header = {
        "kind": KIND, "schema_version": SCHEMA, "algo_version": ALGO_VERSION, "config_hash": config.fingerprint(), "masks": mask_fingerprint(config.masks),
        "format": model.format, "miner": {"depth": config.depth, "threshold": config.threshold, "max_children": config.max_children, "max_templates": config.max_templates},
        "counts": {"nodes": len(body["nodes"]), "clusters": len(body["clusters"])},
    }
    lines = b"".join(json.dumps(x, separators=(",", ":"), ensure_ascii=False).encode() + b"\n" for x in (header, body))
    return lines + json.dumps({"sha256": hashlib.sha256(lines).hexdigest()}, separators=(",", ":")).encode() + b"\n"


def to_binary(text: bytes) -> bytes:
    """The binary form of a state: the header, then numbers as arrays and each different token once.

    Layout: ``MAGIC``; header and body frame as blocks (8 bytes of length, then
    the bytes); the SHA-256 of all before.  The body frame has blocks of the
    tokens (joined by NUL), and of whole numbers of 8 bytes: token numbers and
    lengths of the clusters, and the rest of the body as JSON.
    """
    header, body, _ = text.split(b"\n", 2)
    data = json.loads(body)
    number: dict[str, int] = {}
    flat = [number.setdefault(t, len(number)) for c in data["clusters"] for t in c]
    sizes = [len(c) for c in data.pop("clusters")]
    pack = lambda values: np.array(values, dtype="<i8").tobytes()
    blocks = [header, "\0".join(number).encode(), pack(flat), pack(sizes), json.dumps(data, separators=(",", ":"), ensure_ascii=False).encode()]
    out = MAGIC + b"".join(struct.pack("<Q", len(b)) + b for b in blocks)
    return out + hashlib.sha256(out).digest()


def from_binary(raw: bytes) -> bytes:
    """The text form of a binary state; sizes are checked before anything is taken."""
    if len(raw) < len(MAGIC) + 32 or hashlib.sha256(raw[:-32]).digest() != raw[-32:]:
        raise SettingError("the state is damaged: its checksum differs")
    blocks, at, end = [], len(MAGIC), len(raw) - 32
    while at < end:
        if end - at < 8 or (size := struct.unpack_from("<Q", raw, at)[0]) > end - at - 8:
            raise SettingError("the state is cut off")
        blocks.append(raw[at + 8 : at + 8 + size])
        at += 8 + size
    if len(blocks) != 5:
        raise SettingError("the state has other parts than a state of this form")
    header, words, flat, sizes, rest = blocks
    tokens = words.decode().split("\0") if words else []
    flat, sizes = np.frombuffer(flat, dtype="<i8"), np.frombuffer(sizes, dtype="<i8")
    if len(sizes) > MAX_TEMPLATES or (len(sizes) and sizes.min() < 0) or sizes.sum() != len(flat) or (len(flat) and not 0 <= flat.min() <= flat.max() < len(tokens)):
        raise SettingError("the state names tokens that it does not have")
    data, ends = json.loads(rest), np.cumsum(sizes)
    data["clusters"] = [[tokens[k] for k in flat[a:b]] for a, b in zip(ends - sizes, ends, strict=True)]
    lines = header + b"\n" + json.dumps(data, separators=(",", ":"), ensure_ascii=False).encode() + b"\n"
    return lines + json.dumps({"sha256": hashlib.sha256(lines).hexdigest()}).encode() + b"\n"


def loads(raw: bytes, config: MiningConfig) -> Model:
    """Read and check a model; the file is not trusted."""
    if raw[:2] == b"\x1f\x8b":
        with gzip.GzipFile(fileobj=io.BytesIO(raw)) as packed:
            raw = packed.read(MAX_BYTES + 1)
    if len(raw) > MAX_BYTES:
        raise SettingError("the state is larger than 1 GiB")
    if raw.startswith(MAGIC):
        try:
            raw = from_binary(raw)
        except (ValueError, KeyError, TypeError) as error:
            raise SettingError(f"the state cannot be read: {error}") from error
    try:
        first, second, third = raw.split(b"\n")[:3]
        header, check = json.loads(first), json.loads(third)
        if header.get("kind") != KIND:
            raise SettingError("the file is no saved state")
        if header["schema_version"] > SCHEMA:
            raise SettingError("the state has a newer layout")
        if check.get("sha256") != hashlib.sha256(first + b"\n" + second + b"\n").hexdigest():
            raise SettingError("the state is damaged: its checksum differs")
        if header["algo_version"] != ALGO_VERSION:
            raise SettingError("the state was mined by another version of the rules")
        if header["config_hash"] != config.fingerprint():
            raise SettingError("the state was mined with other masks or parameters")
        counts = header["counts"]
        if counts["clusters"] > MAX_TEMPLATES or counts["nodes"] > MAX_NODES:
            raise SettingError("the state has too many templates or nodes")
        body = json.loads(second)
        if any(len(t.encode()) > MAX_TOKEN_BYTES for c in body["clusters"] for t in c):
            raise SettingError("the state has a token that is too long")
        tree = Tree.from_rows(config, body)
        if len(body["history"]) != len(tree.clusters):
            raise SettingError("the state has a history for other clusters")
        if config.on_full == "evict":
            ranks = body.get("recency")
            if ranks is None or sorted(ranks) != list(range(len(tree.clusters))):
                raise SettingError("the ranks of the state are no permutation")
            tree.recency = ranks  # type: ignore[attr-defined]
        return Model(config, tree, body["history"], {n: h for n, h in body["overflow"]}, header["format"])
    except SettingError:
        raise
    except (ValueError, KeyError, TypeError, IndexError, AttributeError) as error:
        raise SettingError(f"the state cannot be read: {error}") from error


def save(model: Model, path: str | Path) -> None:
    """Write beside the target and move into place; ``.gz`` is compressed, ``.bin`` (before it) is the binary form."""
    raw = dumps(model)
    if ".bin" in Path(path).suffixes[-2:]:
        raw = to_binary(raw)
    if str(path).endswith(".gz"):
        raw = gzip.compress(raw, mtime=0)
    staged = Path(f"{path}.{os.getpid()}.new")
    staged.write_bytes(raw)
    os.replace(staged, path)


def load(path: str | Path, config: MiningConfig | None = None) -> Model:
    if Path(path).stat().st_size > MAX_BYTES:
        raise SettingError("the state is larger than 1 GiB")
    return loads(Path(path).read_bytes(), config or MiningConfig())
