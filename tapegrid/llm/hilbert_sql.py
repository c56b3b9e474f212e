"""DuckDB SQL of operator 8: quantile cells, Hilbert index, checksums and runs, written out from its parameters."""

from __future__ import annotations


def hilbert_steps(bits: int, dims: int) -> tuple[str, str]:
    """The curve's steps as a chain of common table expressions over columns x0, x1 ..., and the last one's name."""
    xs = [f"x{i}" for i in range(dims)]
    steps, last = [], "cells"

    def step(new: dict[str, str]) -> None:
        nonlocal last
        name = f"s{len(steps)}"
        steps.append(f"{name} AS (SELECT * REPLACE ({', '.join(f'{v} AS {k}' for k, v in new.items())}) FROM {last})")
        last = name

    for b in range(bits - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        for i in range(dims):
            on = f"x{i} & {bit} <> 0"
            swap = f"xor(x0, x{i}) & {low}"
            step({"x0": f"CASE WHEN {on} THEN xor(x0, {low}) ELSE xor(x0, {swap}) END"} | ({f"x{i}": f"CASE WHEN {on} THEN x{i} ELSE xor(x{i}, {swap}) END"} if i else {}))
    for i in range(1, dims):
        step({f"x{i}": f"xor(x{i}, x{i - 1})"})
    flip = "0"
    for b in range(bits - 1, 0, -1):
        flip = f"xor({flip}, CASE WHEN x{dims - 1} & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    step({x: f"xor({x}, {flip})" for x in xs})
    index = " + ".join(f"(((x{i} >> {b}) & 1) << {b * dims + dims - 1 - i})" for b in range(bits) for i in range(dims))
    steps.append(f"curved AS (SELECT *, CAST({index} AS BIGINT) AS hilbert FROM {last})")
    return ", ".join(steps), "curved"


def hilbert_sql(dimensions: dict[str, bool], shards: int, bits: int) -> str:
    """The rows of hilbert_shards over documents. dimensions: name, and whether it is a string."""
    n = 1 << bits
    cuts, cells = [], []
    for i, (c, string) in enumerate(dimensions.items()):
        if string:
            cuts.append(f"""c{i} AS (SELECT list(v) AS at FROM (SELECT {c} AS v, sum(count(*)) OVER (ORDER BY {c}) AS upto, count(*) AS n, sum(count(*)) OVER () / {n} AS step FROM d WHERE {c} IS NOT NULL GROUP BY {c}) WHERE floor(upto / step) > floor((upto - n) / step))""")
            below = f"list_filter(c{i}.at, lambda v: v < {c})"
        else:
            cuts.append(f"c{i} AS (SELECT list_distinct([s[CAST(ceil(len(s) * k / {n}.0) AS BIGINT)] FOR k IN range(1, {n})]) AS at FROM (SELECT list_sort(list(CAST({c} AS DOUBLE)) FILTER (WHERE {c} IS NOT NULL)) AS s FROM d))")
            below = f"list_filter(c{i}.at, lambda v: v <= {c})"
        cells.append(f"CASE WHEN {c} IS NULL THEN 0 ELSE least(len({below}) + 1, {n - 1}) END AS x{i}")
    steps, last = hilbert_steps(bits, len(dimensions))
    return f"""
        WITH d AS (
          SELECT *, hex(encode(coalesce(text, ''))) AS raw FROM documents
        ), crcs AS (
          SELECT [list_reduce(list_prepend(CAST(b AS BIGINT), [CAST(0 AS BIGINT) FOR j IN range(8)]), lambda x, j: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)) FOR b IN range(256)] AS t
        ), summed AS (
          SELECT d.*, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || substr(raw, 2 * p + 1, 2) AS BIGINT) FOR p IN range(length(raw) // 2)]), lambda crc, b: xor(crc >> 8, t[(xor(crc, b) & 255) + 1]))) AS text_crc32 FROM d, crcs
        ), {', '.join(cuts)}, cells AS (
          SELECT doc_id, length(raw) // 2 + 16 AS size, text_crc32, {', '.join(cells)} FROM summed, {', '.join(f'c{i}' for i in range(len(dimensions)))}
        ), {steps}, placed AS (
          SELECT *, row_number() OVER (ORDER BY hilbert, text_crc32, size, doc_id) - 1 AS p, count(*) OVER () // {shards} AS each, count(*) OVER () % {shards} AS more FROM {last}
        )
        SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(CASE WHEN p < more * (each + 1) THEN p // (each + 1) ELSE more + (p - more * (each + 1)) // each END AS INTEGER) AS shard,
          CAST(CASE WHEN p < more * (each + 1) THEN p % (each + 1) ELSE (p - more * (each + 1)) % each END AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, hilbert FROM placed
    """
