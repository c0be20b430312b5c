"""What tests share: the sample tables and a comparison with DuckDB."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    return ("nan" if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v


def rows_of(df) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted((tuple(value(r[c]) for c in columns) for r in df.collect()), key=repr)


def duck_rows(sql: str, sf_dir: str = SF) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    r = con.sql(sql)
    order = sorted(range(len(r.columns)), key=lambda i: r.columns[i])
    return [r.columns[i] for i in order], sorted((tuple(value(x[i]) for i in order) for x in r.fetchall()), key=repr)


def ratio(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def judged(r, found):
    """(status, score, source, problems) of a normalised entry and its candidates, by plain Python."""
    names = "_title", "_doi", "_names"
    year_score = lambda a, b: 0.5 if a is None or b is None else {0: 1.0, 1: 0.8}.get(abs(a - b), 0.0)
    if not found:
        return "not_found", 0.0, None, "no matching record found in any source"
    rows = []
    for c in found:
        (t, d, n), (ct, cd, cn) = ([x[k] for k in names] for x in (r, c))
        sim = 0.0 if t is None or ct is None else 1.0 if t == ct else ratio(t, ct)
        overlap = sum(x in cn for x in n) / len(n) if n else 0.0
        score = 0.8 * sim + 0.2 * year_score(r.year, c.year) if not n or not c.authors else 0.6 * sim + 0.25 * overlap + 0.15 * year_score(r.year, c.year)
        rows.append((1.0 if d is not None and d == cd else score, sim, overlap, c))
    ids = [x for x in rows if x[3].matched_by != "search"]
    score, sim, overlap, c = min(ids, key=lambda x: (-x[1], x[3].cand_ord)) if ids else min(rows, key=lambda x: (-x[0], x[3].cand_ord))
    problems = []
    if r.year is not None and c.year is not None and abs(r.year - c.year) > 1:
        problems.append(f"cited year is {r.year}, but the {c.source} record says {c.year}")
    if r._names and c.authors and overlap < 0.5:
        problems.append(f"cited authors ({'; '.join(r.authors[:4])}) disagree with the {c.source} record ({'; '.join(c.authors[:4])})")
    if r._doi is not None and c._doi is not None and r._doi != c._doi:
        problems.append(f"cited DOI is {r._doi}, but the record's DOI is {c._doi}")
    if ids and r.title is not None and sim < 0.5:
        said = "DOI" if c.matched_by == "doi" else "arXiv id"
        return "mismatch", score, c.source, f'the cited {said} resolves to a different work: "{c.title}" ({c.year if c.year is not None else "n.d."})'
    if ids or score >= 0.8 or sim >= 0.9:
        return "mismatch" if problems else "verified", score, c.source, "; ".join(problems)
    if score >= 0.45:
        return "ambiguous", score, c.source, ""
    return "not_found", score, c.source, "no retrieved record plausibly matches the cited work"
