"""DuckDB SQL of the queries that SQL can express, over whole tables.

Language ID (trained classifiers), lattice scores, SimHash classes, vector
packing and the line join have none: they are tested against brute force,
enumeration and held-out accuracy in tests/llm."""

from __future__ import annotations

from bayes_ops.llm import mixing, quality, urls

ORACLE: dict[str, str] = {}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _fence(metric: str, side: str) -> str:
    least = quality.RULES[metric][0]
    spread = f"greatest(q75 - q25, {least})"
    edge = f"q75 + {quality.FENCE} * {spread}" if side == "high" else f"q25 - {quality.FENCE} * {spread}"
    return f"max(CASE WHEN metric = '{metric}' THEN {edge} END) AS {metric}_{side}"


_SIDES = [(m, s) for m, (_, side) in quality.RULES.items() for s in (("high", "low") if side == "both" else (side,))]


def _quartiles(keys: str) -> str:
    by = f"{keys}, metric" if keys else "metric"
    return f"""SELECT {by}, max(al) AS n, min(CASE WHEN upto * 4 >= al THEN bucket END) AS q25,
       min(CASE WHEN upto * 4 >= al * 3 THEN bucket END) AS q75
FROM (SELECT *, sum(c) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, sum(c) OVER (PARTITION BY {by}) AS al
      FROM (SELECT {by}, bucket, sum(c) AS c FROM sk GROUP BY ALL)) GROUP BY {by}"""


ORACLE["op1_quality_rules"] = rf"""WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t, {_WORDS} AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
runs AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS g
         FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM runs) WHERE c > 1),
rep AS (SELECT rid, sum(least(5, coalesce(i - b, 5))) AS n_repeat_words
        FROM (SELECT *, lag(i) OVER (PARTITION BY rid ORDER BY i) AS b FROM twice) GROUP BY rid),
m AS (SELECT rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines
      FROM d LEFT JOIN rep USING (rid)),
r AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        1000 * word_chars // greatest(n_words, 1) AS word_length, 1000 * n_symbols // greatest(n_words, 1) AS symbols,
        1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
        1000 * n_repeat_words // greatest(n_words, 1) AS repeats FROM m),
lng AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {m} AS v FROM r WHERE NOT base_failed" for m in quality.RULES)}),
sk AS (SELECT lang, source, metric, (v >> sh) << sh AS bucket, count(*) AS c
       FROM (SELECT *, greatest(length(bin(v)) - 7, 0)::INT AS sh FROM lng) GROUP BY ALL),
o AS ({_quartiles("lang, source")}), l AS ({_quartiles("lang")}), e AS ({_quartiles("")}),
f AS (SELECT o.lang, o.source, o.metric,
        CASE WHEN o.n >= {quality.MIN_DOCS} THEN o.q25 WHEN l.n >= {quality.MIN_DOCS} THEN l.q25 ELSE e.q25 END AS q25,
        CASE WHEN o.n >= {quality.MIN_DOCS} THEN o.q75 WHEN l.n >= {quality.MIN_DOCS} THEN l.q75 ELSE e.q75 END AS q75
      FROM o JOIN l ON o.metric = l.metric AND o.lang IS NOT DISTINCT FROM l.lang JOIN e ON o.metric = e.metric),
fences AS (SELECT lang, source, {", ".join(_fence(m, s) for m, s in _SIDES)} FROM f GROUP BY lang, source),
j AS (SELECT r.*, concat_ws(',', {", ".join(f"CASE WHEN r.{m} {'>' if s == 'high' else '<'} x.{m}_{s} THEN '{m}_{s}' END" for m, s in _SIDES)}) AS failed
      FROM r LEFT JOIN fences x ON r.lang IS NOT DISTINCT FROM x.lang AND r.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed = '' AS kept, failed FROM j"""


# Control strings of the chat template and of common ones (fixed values, as in chat.CONTROL).
_CONTROL = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>", "<pad>", "<bos>", "<eos>"]


def _escaped(c: str) -> str:
    def count(s: str) -> str:
        return f"(length({c}) - length(replace({c}, '{s}', ''))) // {len(s)}"
    slash = count("\\")
    return f"(length({c}) + {slash} + 2 * ({' + '.join(count(s) for s in _CONTROL)}))"


ORACLE["op7_chat_format"] = f"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns,
        string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns,
        coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (r = 'assistant'), '') AS loss,
        sum(24 + {_escaped("r")} + {_escaped("x")}) AS chars
      FROM t GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256,
       CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(chars AS BIGINT) AS formatted_chars FROM g"""


_UNIT = 60 - mixing.BITS * mixing.LEVELS
ORACLE["op8_mixing"] = f"""WITH d AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) >> {_UNIT} AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, {list(mixing.WEIGHTS)}[1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} AS INT)] AS weight,
        source_size * {mixing.MAX_REPEAT} AS cap FROM s),
c AS (SELECT *, row_number() OVER o AS place,
        (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS share
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
b AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight
        * (SELECT min_by(share, place) FROM c WHERE cap >= share * weight)) AS target FROM c),
t AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM b),
h AS (SELECT source, u, sum(size) AS n FROM d GROUP BY source, u),
run AS (SELECT h.*, t.target - t.copies * t.source_size AS lft, sum(n) OVER (PARTITION BY h.source ORDER BY u) AS upto
        FROM h JOIN t ON h.source IS NOT DISTINCT FROM t.source),
cut AS (SELECT source, min(CASE WHEN upto > lft THEN u END) AS edge, min_by(n, u) FILTER (upto > lft) AS edge_n,
          min(lft) - coalesce(max(CASE WHEN upto <= lft THEN upto END), 0) AS lft FROM run GROUP BY source)
SELECT doc_id, size, t.source_size, coalesce(t.target, 0.0) AS target,
       CAST(size * least({mixing.MAX_REPEAT}, t.copies + CASE WHEN t.source_size > 0
         AND u < edge + CASE WHEN edge_n < 2 * lft THEN 1 ELSE 0 END THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN cut ON d.source IS NOT DISTINCT FROM cut.source"""


def _url_sql() -> str:
    weights, bias = urls.train(urls.LABELLED)

    def total(n: int) -> str:
        h = str(n)
        for k in range(n):
            h = f"(({h}) * 131 + cs[i + {k}]) % 1000003"
        return f"coalesce(list_sum(list_transform(range(1, len(cs) - {n - 2}), lambda i: ws[1 + CAST(({h}) % {urls.DIMS} AS INT)])), 0.0)"

    def case(verdict: bool) -> str:
        out = []
        for v, r in sorted(urls.RULES, key=lambda x: (-len(x[1]), x[1])):
            host, _, path = r.partition("/")
            out.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{v if verdict else r}'")
        return "CASE " + " ".join(out) + " END"

    count = " + ".join(f"greatest(len(cs) - {n - 1}, 0)" for n in urls.GRAMS)
    return f"""WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
w AS (SELECT [{", ".join(f"{v!r}::DOUBLE" for v in weights)}] AS ws),
c AS (SELECT q.*, ws, list_transform(string_split('^' || host || '$^' || path || '$', ''), lambda x: CAST(unicode(x) AS BIGINT)) AS cs FROM q, w),
s AS (SELECT *, {bias!r}::DOUBLE + ({" + ".join(total(n) for n in urls.GRAMS)}) / sqrt(greatest({count}, 1)) AS score FROM c)
SELECT page_id, host, path, {case(False)} AS rule,
       coalesce({case(True)}, CASE WHEN score >= 0 THEN 'block' ELSE 'allow' END) AS verdict, round(score, 4) AS score FROM s"""


ORACLE["op9_url_filter"] = _url_sql()


def _test_words(c: str) -> str:
    low = f"translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


ORACLE["op10_decontamination"] = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_test_words("text")} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_test_words("text")} AS ws FROM benchmark),
win AS (SELECT DISTINCT item, least(len(ws), 10) AS l, list_slice(ws, i, i + 9) AS g
        FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT l FROM win),
grams AS (SELECT rid, l, i, list_slice(ws, i, i + l - 1) AS g
          FROM (SELECT rid, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d, lens)),
hits AS (SELECT rid, i, win.l, item FROM grams JOIN win ON grams.l = win.l AND grams.g = win.g),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + l)) AS p FROM hits) GROUP BY rid),
ids AS (SELECT rid, list_sort(list(DISTINCT item)) AS ids FROM hits WHERE item IS NOT NULL GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN ids USING (rid)"""


_LETTERS = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16))"
_TAKEN = ["0", *(" + ".join(f"l{k}.bit" for k in range(1, n + 1)) for n in range(1, 5))]
_STEPS = " UNION ALL ".join(
    f"SELECT ord, CAST({k} AS INTEGER) AS step, b{k} AS before, f{k} AS bit FROM orders" for k in range(1, 6))
ORACLE["op11_filter_audit"] = rf"""WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
lab AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
        FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
      FROM d LEFT JOIN lab ON d.doc_id = lab.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m GROUP BY part, mask),
orders AS (SELECT concat({", ".join(f"l{k}.f" for k in range(1, 6))}) AS ord,
             {", ".join(f"{_TAKEN[k - 1]} AS b{k}, l{k}.bit AS f{k}" for k in range(1, 6))}
           FROM {", ".join(f"{_LETTERS} l{k}(f, bit)" for k in range(1, 6))}
           WHERE {" + ".join(f"l{k}.bit" for k in range(1, 6))} = 31
             AND {" AND ".join(f"l{i}.bit <> l{j}.bit" for j in range(2, 6) for i in range(1, j))}),
steps AS ({_STEPS}),
r AS (SELECT part, ord, step, bit,
        sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN g ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN x ELSE 0 END) AS toxic_lost
      FROM c, steps GROUP BY ALL)
SELECT part, ord AS filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""
