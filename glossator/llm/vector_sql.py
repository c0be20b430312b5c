"""DuckDB SQL for the queries on embeddings."""

from __future__ import annotations

_SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _nearest(number: int) -> str:
    """a: each part's nearest entry of book ``number``, and its distance."""
    far = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    return f"""a{number} AS MATERIALIZED (SELECT vec_id, part, x, w.e AS entry, w.d AS far FROM (SELECT vec_id, part, x, min({{'d': {far}::BIGINT, 'e': entry}}) AS w FROM p JOIN b{number} USING (part) GROUP BY vec_id, part, x))"""


def _moved(number: int) -> str:
    """b: book ``number`` + 1, entries moved to the floor of their parts' mean."""
    return f"""m{number} AS (SELECT part, entry, list(v ORDER BY i) AS c FROM (SELECT part, entry, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS v FROM a{number}, unnest(range(1, len(x) + 1)) AS u(i) GROUP BY ALL) GROUP BY ALL),
b{number + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b.c) AS c FROM b{number} b LEFT JOIN m{number} m USING (part, entry))"""


def vector_codes(rounds: int = 4) -> str:
    steps = ",\n".join(f"{_nearest(k)},\n{_moved(k)}" for k in range(rounds))
    return f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS x FROM embeddings WHERE {_SOUND}),
p AS MATERIALIZED (SELECT vec_id, part, x[part * len(x) // 4 + 1:(part + 1) * len(x) // 4] AS x FROM v, unnest(range(4)) AS u(part)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < 256),
b0 AS MATERIALIZED (SELECT part, entry, x AS c FROM p JOIN f USING (vec_id)),
{steps},
{_nearest(rounds)},
s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
r AS (SELECT vec_id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM r JOIN v USING (vec_id), s"""


HARD_NEGATIVES = f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS x FROM embeddings WHERE label IS NOT NULL AND {_SOUND}),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i]))::BIGINT AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op12_vector_codes": vector_codes(), "op13_hard_negatives": HARD_NEGATIVES}
