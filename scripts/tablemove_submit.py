"""Launcher for spark-submit: ``spark-submit --py-files tablemove.zip scripts/tablemove_submit.py <command> ...``."""

from tablemove.cli import main

main()
