"""The derived tables of fixtures.py in DuckDB SQL, as named parts that a query's SQL puts in front."""

from __future__ import annotations

_START = "(10 * j + 6 * (j // 4) + ((j % 4) * ((j % 4) - 1)) // 2)"

PARTS: dict[str, str] = {
    "utt": """SELECT lpad(CAST(conv_id AS VARCHAR), 5, '0') || '_' || lpad(CAST(turn AS VARCHAR), 2, '0') || '_000000' AS utt_id, CAST(conv_id AS BIGINT) AS conv_id,
      CAST(turn AS BIGINT) AS turn, CAST(conv_id % 2 AS INTEGER) AS dataset_idx, text AS reference, CASE WHEN conv_id % 5 = 0 THEN 'spk' || conv_id END AS speaker_id,
      CASE WHEN conv_id % 3 <> 0 THEN 'rec' || conv_id END AS group_id,
      'audio/' || lpad(CAST(conv_id AS VARCHAR), 5, '0') || '_' || lpad(CAST(turn AS VARCHAR), 2, '0') || '_000000.wav' AS audio_path FROM conversations""",
    "refs": """SELECT utt_id, conv_id, turn, dataset_idx, ws[i + 1] AS w, i AS pos, (conv_id * 7 + turn * 13 + i * 31) % (4 + conv_id % 17) AS op
      FROM (SELECT *, list_filter(regexp_split_to_array(reference, '\\s+'), lambda x: x <> '') AS ws FROM utt) q, unnest(range(0, len(ws))) AS t(i)""",
    "hyps": """SELECT utt_id, conv_id, turn, dataset_idx, h, op, row_number() OVER (PARTITION BY utt_id ORDER BY pos, sub) - 1 AS j FROM (
      SELECT utt_id, conv_id, turn, dataset_idx, CASE WHEN op = 1 THEN 'x' || w ELSE w END AS h, op, pos, 0 AS sub FROM refs WHERE op <> 0
      UNION ALL SELECT utt_id, conv_id, turn, dataset_idx, 'uh', op, pos, 1 FROM refs WHERE op = 2) q""",
    "times": f"SELECT *, ({_START} + 2) * CAST(0.04 AS DOUBLE) AS s, ({_START} + 8) * CAST(0.04 AS DOUBLE) AS e FROM hyps",
    "frames": f"""SELECT utt_id, conv_id, frame, token, (9999 - ((conv_id * 3 + turn * 5 + frame * 17) % 97) * (CASE WHEN op IN (1, 2) AND k BETWEEN 2 AND 7 THEN 60 ELSE 10 END))::DOUBLE / 10000 AS raw
      FROM (SELECT *, {_START} + k AS frame, CASE WHEN k BETWEEN 2 AND 4 OR (k BETWEEN 5 AND 7 AND length(h) <= 2) THEN '▁' || substr(h, 1, 2) WHEN k BETWEEN 5 AND 7 THEN substr(h, 3) ELSE '<blk>' END AS token
        FROM hyps, unnest(range(0, 10 + j % 4)) AS t(k)) q""",
    "clipped": "SELECT *, least(1 - 1e-9, greatest(1e-9, raw)) AS p, token = '<blk>' AS b FROM frames",
    "segs": """SELECT utt_id || '_' || blk AS segment_id, utt_id, conv_id, turn, dataset_idx, blk, CASE WHEN turn % 5 = 4 THEN 'test' ELSE 'train' END AS split, count(*) AS reference_words,
      count(*) FILTER (op <= 2) AS edit_errors, CAST(sum(CASE op WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END) AS BIGINT) AS hypothesis_words, greatest(0.0::DOUBLE, 1 - (count(*) FILTER (op <= 2))::DOUBLE / count(*)) AS accuracy
      FROM (SELECT *, pos // (10 + conv_id % 31) AS blk FROM refs) q GROUP BY ALL HAVING count(*) >= 10""",
    "ests": """SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, accuracy * 0.8 + 0.1 + ((row_number() OVER (ORDER BY segment_id) * 37) % 21 - 10) / 200.0::DOUBLE)) AS estimated_accuracy FROM segs""",
    "tokens": "SELECT *, regexp_extract_all(lower(reference), '[\\p{L}\\p{N}]+(?:[''’][\\p{L}\\p{N}]+)?') AS toks FROM utt",
}
_NEEDS = {"utt": [], "refs": ["utt"], "hyps": ["refs"], "times": ["hyps"], "frames": ["hyps"], "clipped": ["frames"], "segs": ["refs"], "ests": ["segs"], "tokens": ["utt"]}


def sql(parts: list[str], body: str, recursive: bool = False, extra: list[tuple[str, str]] | None = None) -> str:
    """WITH the parts and what they need, then ``extra`` parts, then the body."""
    order: list[str] = []

    def add(p: str) -> None:
        for q in _NEEDS[p]:
            add(q)
        if p not in order:
            order.append(p)

    for p in parts:
        add(p)
    named = [(p, PARTS[p]) for p in order] + (extra or [])
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS ({q})" for n, q in named) + "\n" + body
