"""What both jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
import sys


def settings(given: list[str] | None, description: str, places: list[str]) -> tuple[argparse.Namespace, dict]:
    """Paths from the command line and options from the config file."""
    parser = argparse.ArgumentParser(description=description)
    for place in places:
        parser.add_argument(f"--{place}", required=True, help=f"path or URI of the {place}")
    parser.add_argument("--config", required=True, help="JSON file of the job's options")
    parser.add_argument("--master", help="Spark master; by default what spark-submit says")
    said = parser.parse_args(given)
    with open(said.config, encoding="utf-8") as f:
        options = json.load(f)
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    return said, options
