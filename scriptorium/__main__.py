"""Scores of one text on the command line: ``python -m scriptorium [--text T | --file F] [--json]``, else from standard input."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from scriptorium.operators import scoring
from scriptorium.session import create


def report(text: str, lexicon: scoring.Lexicon) -> dict:
    """Composite score, dimensions and readability of a text."""
    rows = create("local[2]").createDataFrame([(0, text)], "doc_id int, text string")
    scores = scoring.dimensions(rows, lexicon)
    found = scores.join(scoring.composite(scores), "doc_id").join(scoring.readability_rows(rows), "doc_id").first().asDict()
    found.pop("doc_id")
    return found


def main(arguments: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="scriptorium", description=__doc__)
    given = parser.add_mutually_exclusive_group()
    given.add_argument("--text")
    given.add_argument("--file")
    parser.add_argument("--json", action="store_true", help="one JSON object instead of lines")
    parser.add_argument("--lexicon", help="a JSON file of phrase lists by name")
    chosen = parser.parse_args(arguments)
    text = chosen.text if chosen.text is not None else Path(chosen.file).read_text(encoding="utf-8") if chosen.file else sys.stdin.read()
    lists = json.loads(Path(chosen.lexicon).read_text(encoding="utf-8")) if chosen.lexicon else {}
    found = report(text, scoring.Lexicon(**{k: tuple(v) for k, v in lists.items()}))
    print(json.dumps(found, ensure_ascii=False) if chosen.json else "\n".join(f"{k}: {v}" for k, v in found.items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
