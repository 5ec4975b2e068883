from sievelog.cli import main

main()
