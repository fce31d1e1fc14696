"""The checking statement of the quality rules (12): the same estimates in one statement of SQL.

Written over CTEs: statistics from regular expressions and unnested runs of words, medians from
counts by bins, and a chain of concentration steps, each with its Cholesky root by columns.
"""

from __future__ import annotations

from murmurate.llm.outliers import BINS, CONSISTENCY, COVERAGE, CUTOFF, FLOORS, LEAST, SLOTS, STEPS

_DIMENSIONS = range(len(FLOORS))
_PAIRS = [(i, j) for i in _DIMENSIONS for j in range(i + 1)]


def sql(docs: str = "documents") -> str:
    """The same numbers and verdicts over ``documents`` as a statement for a single-node database."""
    d, pairs = _DIMENSIONS, _PAIRS
    blank = r"'[\x20\x09-\x0D]+'"
    steps = []
    for s in range(STEPS):
        side = [" + ".join(f"w{i}{j} * (x{j} - m{j})" for j in range(i + 1)) for i in d]
        square = " + ".join(f"({x}) * ({x})" for x in side)
        sums = ", ".join([f"sum(x{i} - m{i}) AS s{i}" for i in d] + [f"sum((x{i} - m{i}) * (x{j} - m{j})) AS q{i}{j}" for i, j in pairs] + [f"min(m{i}) AS m{i}" for i in d])
        again = ", ".join([f"sum(s{i}) / sum(n) AS a{i}" for i in d] + [f"sum(q{i}{j}) / sum(n) AS b{i}{j}" for i, j in pairs] + [f"min(m{i}) AS o{i}" for i in d])
        moved = ", ".join([f"o{i} + a{i} AS m{i}" for i in d] + [f"{CONSISTENCY} * (b{i}{j} - a{i} * a{j}) + {FLOORS[i] ** 2 if i == j else 0.0} AS c{i}{j}" for i, j in pairs])
        steps.append(f"near{s} AS (SELECT *, floor({BINS} * ln({square} + 1e-9)) AS bin FROM vectors JOIN e{s} USING (grp))")
        steps.append(f"bins{s} AS (SELECT grp, bin, count(*) AS n, {sums} FROM near{s} GROUP BY 1, 2)")
        steps.append(f"upto{s} AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY bin) - n AS before, sum(n) OVER (PARTITION BY grp) AS whole FROM bins{s})")
        steps.append(f"core{s} AS (SELECT grp, {again} FROM upto{s} WHERE before < {COVERAGE} * whole GROUP BY 1)")
        last = f"c{s}"
        steps.append(f"{last} AS (SELECT grp, {moved} FROM core{s})")
        for i, j in sorted(pairs, key=lambda p: (p[1], p[0])):
            left = " - ".join([f"c{i}{j}", *(f"l{i}{k} * l{j}{k}" for k in range(j))])
            steps.append(f"r{s}_{i}{j} AS (SELECT *, {f'sqrt({left})' if i == j else f'({left}) / l{j}{j}'} AS l{i}{j} FROM {last})")
            last = f"r{s}_{i}{j}"
        for i in d:
            for j in range(i, -1, -1):
                inner = " + ".join(f"l{i}{k} * w{k}{j}" for k in range(j, i))
                steps.append(f"v{s}_{i}{j} AS (SELECT *, {f'-({inner})' if inner else '1.0'} / l{i}{i} AS w{i}{j} FROM {last})")
                last = f"v{s}_{i}{j}"
        steps.append(f"e{s + 1} AS MATERIALIZED (SELECT grp, {', '.join(f'm{i}' for i in d)}, {', '.join(f'w{i}{j}' for i, j in pairs)} FROM {last})")
    side = [" + ".join(f"w{i}{j} * (x{j} - m{j})" for j in range(i + 1)) for i in d]
    quartile = lambda i, k: f"((min(bin) FILTER (dim = {i} AND 4 * upto >= {k} * whole)) + 0.5) * {FLOORS[i] / SLOTS}"
    start = ", ".join([f"{quartile(i, 2)} AS m{i}" for i in d] + [f"{f'1 / greatest(({quartile(i, 3)} - {quartile(i, 1)}) / 1.349, {FLOORS[i]})' if i == j else '0.0'} AS w{i}{j}" for i, j in pairs])
    return f"""
    WITH texts AS (SELECT row_number() OVER () AS place, doc_id, lang, source, coalesce(text, '') AS text FROM {docs}),
      cut AS (SELECT *, list_filter(regexp_split_to_array(text, {blank}), lambda w: w <> '') AS w,
          list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, {blank}, '', 'g') <> '') AS lines FROM texts),
      runs AS (SELECT place, unnest(range(1, len(w) - 1)) AS i, unnest([w[k:k + 2] for k in range(1, len(w) - 1)]) AS run FROM cut),
      again AS (SELECT place, i FROM (SELECT *, count(*) OVER (PARTITION BY place, run) AS n FROM runs) WHERE n > 1),
      covered AS (SELECT place, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
      stats AS (SELECT cut.place, doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, {blank}, '', 'g')) AS word_chars,
          length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
          len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
        FROM cut LEFT JOIN covered USING (place)),
      failed AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats),
      sizes AS (SELECT lang, source, count(*) AS n FROM failed WHERE NOT base_failed GROUP BY ALL),
      langs AS (SELECT lang, sum(n) AS n_lang FROM sizes WHERE n < {LEAST} GROUP BY ALL),
      rest AS (SELECT coalesce(sum(n_lang), 0) AS n_rest FROM langs WHERE n_lang < {LEAST}),
      pairs AS (SELECT sizes.lang, source, CASE WHEN n >= {LEAST} THEN ['1', sizes.lang, source] WHEN n_lang >= {LEAST} THEN ['2', sizes.lang, NULL]
          WHEN n_rest >= {LEAST} THEN ['3', NULL, NULL] END AS grp FROM sizes LEFT JOIN langs ON langs.lang IS NOT DISTINCT FROM sizes.lang, rest),
      vectors AS MATERIALIZED (SELECT place, grp, ln(n_words) AS x0, ln(word_chars / n_words) AS x1, sqrt(n_symbols / n_words) AS x2, ln(1 + n_dup_lines) AS x3,
          asin(sqrt(n_repeat_words / n_words)) AS x4
        FROM failed JOIN pairs ON pairs.lang IS NOT DISTINCT FROM failed.lang AND pairs.source IS NOT DISTINCT FROM failed.source WHERE NOT base_failed AND grp IS NOT NULL),
      slots AS (SELECT grp, unnest([0, 1, 2, 3, 4]) AS dim, unnest([floor(v[1] / v[2]) for v in [[x0, {FLOORS[0] / SLOTS}], [x1, {FLOORS[1] / SLOTS}], [x2, {FLOORS[2] / SLOTS}], [x3, {FLOORS[3] / SLOTS}], [x4, {FLOORS[4] / SLOTS}]]]) AS bin FROM vectors),
      counted AS (SELECT grp, dim, bin, count(*) AS n FROM slots GROUP BY ALL),
      summed AS (SELECT *, sum(n) OVER (PARTITION BY grp, dim ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY grp, dim) AS whole FROM counted),
      e0 AS (SELECT grp, {start} FROM summed GROUP BY 1),
      {", ".join(steps)},
      judged AS (SELECT place, {" + ".join(f"({x}) * ({x})" for x in side)} AS distance FROM vectors JOIN e{STEPS} USING (grp))
    SELECT doc_id, cast(n_words AS bigint) AS n_words, cast(word_chars AS bigint) AS word_chars, cast(n_symbols AS bigint) AS n_symbols,
      cast(n_dup_lines AS bigint) AS n_dup_lines, cast(n_repeat_words AS bigint) AS n_repeat_words, base_failed,
      NOT base_failed AND coalesce(distance <= {CUTOFF}, true) AS kept
    FROM failed LEFT JOIN judged USING (place)"""
