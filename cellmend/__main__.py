"""Runs the command line."""

from cellmend.cli import main

raise SystemExit(main())
