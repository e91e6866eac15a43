"""Builders of block streams for tests."""

from docloom import schemas


def blocks(spark, rows, doc="d"):
    """rows: dicts of kind, text and what else differs from the defaults."""
    base = {"doc_id": doc, "page": 1, "level": 0, "sec": "", "title": "", "table_id": "", "grid": None, "spans": False, "cells": None, "text": ""}
    names = [c.split()[0] for c in ("doc_id", "block_ix", "kind", "text", "page", "level", "sec", "title", "table_id", "grid", "spans", "cells")]
    full = [{**base, "block_ix": k, **r} for k, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], schemas.BLOCKS)


def heading(text, level=1, sec="", page=1):
    return {"kind": "heading", "text": f"{sec} {text}".strip(), "title": text, "sec": sec, "level": level, "page": page}


def text(t, page=1):
    return {"kind": "text", "text": t, "page": page}


def table(grid, page=1, tid="t0001", title=""):
    return {"kind": "table", "grid": grid, "page": page, "table_id": tid, "title": title}
