"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.llm import conversation_repair, cover_tree, language, mixing, packing, phrases, preference, quality, relative_lz, secret_scan, simhash, token_files, winnowing
from demandloom.llm.registry import query, table


@query("op10_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its fingerprint and the smallest document it is a near-duplicate of."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


OP2_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (
  SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS p FROM words WHERE len(w) >= 13
), grams AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 12], ' ')) AS g FROM places
), firsts AS (
  SELECT g, min(doc_id) AS owner FROM grams GROUP BY g
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(p, p + 12)) AS i FROM grams JOIN firsts USING (g) WHERE doc_id > owner
), removed AS (
  SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string([x[1] FOR x IN list_zip(w, generate_series(1, len(w))) IF NOT list_contains(coalesce(gone, []), x[2])], ' '), '')) AS kept_sha256
FROM words LEFT JOIN removed USING (doc_id)
"""


@query("op2_relative_lz", OP2_SQL)
def relative_lz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the passages that an earlier document has."""
    found = relative_lz.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op7_token_files")
def token_files_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document in the token files."""
    return token_files.token_digest(table(spark, sf_dir, "documents"), token_files.vocabulary())


def _quality_sql(limits: quality.Limits = quality.Limits()) -> str:
    """The rules as SQL, with the operator's word lists and character classes."""
    bins = [w for words in quality.COMMON_WORDS.values() for w in words]
    classes = [r"[a-z]", r"[A-Z]", r"[\x20\x09-\x0D]", r"[!\x22\x27(),\-./:;?@\[\\\]^_`{}~+=]", r"[0-9]", r"[#*$%&|<>]"]
    chars = ", ".join(f"length(t) - length(regexp_replace(t, '{c}', '', 'g'))" for c in classes)
    common = ", ".join(f"len([x FOR x IN words IF lower(x) = '{w}'])" for w in bins)
    sums = lambda name, n: "[" + ", ".join(f"sum({name}[{i}])" for i in range(1, n + 1)) + "]"  # noqa: E731
    share = lambda name: f"[x / CAST(list_sum({name}) AS DOUBLE) FOR x IN {name}]"  # noqa: E731
    half = lambda i: f"(CASE WHEN z[{i}] > 0 THEN z[{i}] * log2(2 * z[{i}] / (z[1] + z[2])) ELSE 0 END)"  # noqa: E731
    distance = lambda name: f"sqrt(greatest(0, list_sum([({half(1)} + {half(2)}) / 2 FOR z IN list_zip({share('d.' + name)}, {share('r.' + name)})])))"  # noqa: E731
    return rf"""
WITH docs AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), counted AS (
  SELECT doc_id, lang, t, words, len(words) AS n, [{chars}] AS known, [{common}] AS listed,
         [l FOR l IN string_split(t, chr(10)) IF regexp_matches(l, '[^\x20\x09-\x0D]')] AS lines
  FROM docs
), histograms AS (
  SELECT doc_id, lang, words, n, lines, list_append(known, length(t) - list_sum(known)) AS chars, list_append(listed, n - list_sum(listed)) AS common FROM counted
), refs AS (
  SELECT lang, {sums("chars", len(classes) + 1)} AS chars, {sums("common", len(bins) + 1)} AS common FROM histograms
  WHERE lang IN ({", ".join(f"'{x}'" for x in quality.COMMON_WORDS)}) GROUP BY lang HAVING sum(n) > 0
), distances AS (
  SELECT doc_id, min(CASE WHEN list_sum(d.chars) > 0 THEN {distance("chars")} END) AS cd, min(CASE WHEN list_sum(d.common) > 0 THEN {distance("common")} END) AS wd
  FROM histograms d, refs r GROUP BY doc_id
), places AS (
  SELECT doc_id, words, unnest(generate_series(1, n - 7)) AS p FROM histograms WHERE n >= 8
), grams AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(words[p:p + 7], ' ')) AS times FROM places
), covered AS (
  SELECT doc_id, count(DISTINCT i) AS n_repeat FROM (SELECT doc_id, unnest(generate_series(p, p + 7)) AS i FROM grams WHERE times > 1) GROUP BY doc_id
), facts AS (
  SELECT h.doc_id, CAST(n AS BIGINT) AS n_words, CAST(list_sum(chars) - chars[3] AS BIGINT) AS word_chars, CAST(chars[6] AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, cd, wd
  FROM histograms h LEFT JOIN distances d ON h.doc_id = d.doc_id LEFT JOIN covered c ON h.doc_id = c.doc_id
), judged AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM facts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, round(cd, 6) AS char_distance, round(wd, 6) AS word_distance, base_failed,
       NOT base_failed AND NOT (word_chars >= {limits.min_chars} AND coalesce(cd, 0) > {limits.char_distance})
       AND NOT (n_words >= {limits.min_words} AND coalesce(wd, 0) > {limits.word_distance}) AS kept
FROM judged
"""


@query("op1_quality_rules", _quality_sql())
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, distances from the language references and verdict of each document."""
    found = quality.assess(table(spark, sf_dir, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    distances = [F.round(c, 6).alias(c) for c in ("char_distance", "word_distance")]
    return found.select(F.col("source").getField("doc_id").alias("doc_id"), *counts, *distances, "base_failed", "kept")


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM sums
), weighed AS (
  SELECT *, no % 3 + 1 AS w, 3.0 * source_size / (no % 3 + 1) AS ratio FROM ranked
), stops AS (  -- if the k sources that are full soonest are full, the others share the rest
  SELECT *, row_number() OVER (ORDER BY ratio, no) AS k,
         (SELECT sum(source_size) FROM weighed) - 3 * coalesce(sum(source_size) OVER (ORDER BY ratio, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY ratio, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w
  FROM weighed
), level AS (
  SELECT k, rest, rest_w FROM stops WHERE CAST(rest AS DOUBLE) * w / rest_w <= 3 * source_size ORDER BY k LIMIT 1
), targets AS (
  SELECT source, no, source_size, CASE WHEN stops.k < level.k THEN 3.0::DOUBLE * source_size ELSE CAST(level.rest AS DOUBLE) * w / CAST(level.rest_w AS DOUBLE) END AS target
  FROM stops, level
), scale AS (
  SELECT CAST(sum(source_size) AS BIGINT) AS total, CAST(ceil(sum(source_size) / 32.0) AS BIGINT) AS slots,
         CAST(greatest(1, ceil(log2(ceil(sum(source_size) / 32.0)))) AS INT) AS bits
  FROM targets
), points AS (
  SELECT list_sum([((t >> i) & 1) << (bits - 1 - i) FOR i IN range(0, bits)]) AS p
  FROM (SELECT bits, unnest(range(0, slots)) AS t FROM scale)
), shares AS (
  SELECT no, source_size, target, (upto - target) * (CAST(1 << bits AS DOUBLE) / total) AS low,
         CASE WHEN upto >= total * (1 - 1e-12) THEN CAST(1 << bits AS DOUBLE) ELSE upto * (CAST(1 << bits AS DOUBLE) / total) END AS high
  FROM (SELECT *, sum(target) OVER (ORDER BY no) AS upto FROM targets), scale
), asked AS (
  SELECT no, count(p) AS n FROM shares LEFT JOIN points ON p >= low AND p < high GROUP BY no
), places AS (
  SELECT doc_id, no, size, source_size, target, CAST(ceil(source_size / 32.0) AS BIGINT) AS blocks,
         sum(size) OVER (PARTITION BY no ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS a
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 WHEN n >= 3 * blocks THEN 3 * size
            ELSE n // blocks * size + greatest(0, least(size, n % blocks * 32 - a)) END AS BIGINT) AS taken
FROM places JOIN asked USING (no)
"""


@query("op6_mix_sources", OP6_SQL)
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.taken_words(table(spark, sf_dir, "documents"))


@query("op3_secret_scan")
def secret_scan_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of the secrets in each document."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    counts = [F.size(secret_scan.of_kind("spans", k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


@query("op8_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence and place of each piece of each document."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH turns AS (
  SELECT DISTINCT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS chosen, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, chosen ORDER BY turn NULLS FIRST, role, text) AS i,
         '<|' || role || '|>' || chr(10) AS head, text || chr(10) || '<|end|>' || chr(10) AS tail
  FROM turns
), pairs AS (
  SELECT pair_id, max(i) FILTER (chosen) AS nc, max(i) FILTER (NOT chosen) AS nr FROM numbered GROUP BY pair_id
), differ AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, min(coalesce(c.i, r.i)) AS d
  FROM (SELECT * FROM numbered WHERE chosen) c FULL JOIN (SELECT * FROM numbered WHERE NOT chosen) r ON c.pair_id = r.pair_id AND c.i = r.i
  WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text
  GROUP BY 1
), prefixes AS (
  SELECT pair_id, coalesce(d - 1, nc) AS n FROM pairs LEFT JOIN differ USING (pair_id)
), placed AS (
  SELECT *, sum(length(head || tail)) OVER (PARTITION BY pair_id, chosen ORDER BY i) AS upto FROM numbered JOIN prefixes USING (pair_id)
)
SELECT pair_id, CAST(any_value(n) AS BIGINT) AS n_prompt_turns,
       coalesce(string_agg(head || tail, '' ORDER BY i) FILTER (chosen AND i <= n), '') AS prompt,
       coalesce(string_agg(head || tail, '' ORDER BY i) FILTER (chosen AND i > n), '') AS chosen,
       coalesce(string_agg(head || tail, '' ORDER BY i) FILTER (NOT chosen AND i > n), '') AS rejected,
       coalesce(string_agg((upto - length(tail)) || ':' || upto, ',' ORDER BY i) FILTER (chosen AND i > n AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg((upto - length(tail)) || ':' || upto, ',' ORDER BY i) FILTER (NOT chosen AND i > n AND role = 'assistant'), '') AS rejected_spans
FROM placed GROUP BY pair_id
"""


@query("op9_preference_format", OP9_SQL)
def preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) as prompt and two completions."""
    turns = table(spark, sf_dir, "conversations")
    pair, chosen = F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0
    found = preference.preference_pairs(turns, pair, chosen, F.col("turn"), F.col("role"), F.col("text"))
    spans = [preference.spans_text(c).alias(c) for c in ("chosen_spans", "rejected_spans")]
    return found.select("pair_id", "n_prompt_turns", "prompt", "chosen", "rejected", *spans)


@query("op4_byte_cnn_language")
def byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of each document."""
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


OP5_SQL = r"""
WITH rows AS (
  SELECT DISTINCT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scores AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(max(list_sum([x[1] * x[2] FOR x IN list_zip(q.v, r.v)])) AS BIGINT) AS score
  FROM rows q, rows r WHERE q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id AND len(q.v) = len(r.v)
  GROUP BY q.vec_id, r.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM scores QUALIFY rank <= 5
"""


@query("op5_dual_cover_tree", OP5_SQL)
def dual_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors with the highest inner products with each query."""
    return cover_tree.nearest(table(spark, sf_dir, "embeddings"))


OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark
), sized AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM items WHERE len(w) > 0
), wins AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM sized)
), places AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM docs, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, item_id, n, p FROM places JOIN wins USING (n, g)
), covered AS (
  SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS i FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op11_winnowing", OP11_SQL)
def winnowing_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each document that stand in a benchmark item, and a digest of the items."""
    found = winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, (F.col("n_hit") > 0).alias("contaminated"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), sizes AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), grams AS (
  SELECT lang, w[p:p + m - 1] AS g
  FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS p FROM words, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)
), phrases AS (
  SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g HAVING count(*) >= 100
), cuts AS (
  SELECT lang, g, f AS a, unnest(generate_series(1, len(g) - 1)) AS k FROM phrases WHERE len(g) >= 2
), scored AS (
  SELECT c.lang, c.g, c.k, c.a, l.f AS l, r.f AS r, n, CAST(CAST(1000 AS HUGEINT) * c.a * n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cuts c JOIN phrases l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN phrases r ON r.lang = c.lang AND r.g = c.g[k + 1:] JOIN sizes s ON s.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), inner_parts AS (
  SELECT DISTINCT lang, f, g[i:j] AS g
  FROM (SELECT lang, f, g, i, unnest(generate_series(i + 1, len(g))) AS j FROM (SELECT lang, f, g, unnest(generate_series(1, len(g) - 1)) AS i FROM phrases WHERE len(g) >= 3)) WHERE j - i + 1 < len(g)
), kept AS (
  SELECT * FROM lowest c WHERE NOT EXISTS (SELECT 1 FROM inner_parts i WHERE i.lang = c.lang AND i.g = c.g AND 100 * i.f >= 100 * c.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank,
       array_to_string(g, ' ') AS phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""


@query("op12_phrase_mining", OP12_SQL)
def phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents")).drop("k")


def _repair_sql() -> str:
    """Damage, faults, and the cheapest edits by a fold over the rows that keeps the best parse up to each state."""
    crc_table = "[list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) FOR b IN range(0, 256)]"
    crc = "xor(list_reduce(list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, table_of[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
    none = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR, n BIGINT))"
    line = lambda s, role, text: f"{s}.t || CASE WHEN {s}.n > 0 THEN chr(10) ELSE '' END || {role} || ':' || {text}"  # noqa: E731
    way = lambda s, when, cost, edit, role, text: f"CASE WHEN {s}.c IS NOT NULL AND {when} THEN {{c: {s}.c + {cost}, a: {s}.a || '{edit}', t: {line(s, role, text)}, n: {s}.n + 1}} END"  # noqa: E731
    least = lambda ways: f"list_sort(list_filter([{', '.join(ways)}], lambda w: w.c IS NOT NULL))[1]"  # noqa: E731
    steps = [(0, "s", 1, "system"), (0, "u", 2, "user"), (1, "u", 2, "user"), (2, "a", 3, "assistant"), (3, "u", 2, "user")]

    def edited(q: int) -> str:
        ways = [f"CASE WHEN s[{q + 1}].c IS NOT NULL THEN {{c: s[{q + 1}].c + 3, a: s[{q + 1}].a || 'D', t: s[{q + 1}].t, n: s[{q + 1}].n}} END"]
        for p, letter, to, role in steps:
            if to == q:
                ways.append(way(f"s[{p + 1}]", f"NOT r.gone AND r.role[1] = '{letter}'", "r.cut", "K", "r.role", "r.text"))
                if letter != "s":
                    ways.append(way(f"s[{p + 1}]", "NOT r.gone", "r.cut + 2", "R", f"'{role}'", "r.text"))
        return least(ways)

    def inserted(s: str) -> str:
        """One more turn inserted, or none."""
        user = least([f"{s}[3]", *[way(f"{s}[{p + 1}]", "true", 2, "I", "'user'", "''") for p in (0, 1, 3)]])
        assistant = least([f"{s}[4]", way(f"{s}[3]", "true", 2, "I", "'assistant'", "''")])
        return f"[{s}[1], {s}[2], {user}, {assistant}]"

    closed = lambda s: f"list_transform(list_transform([{s}], lambda z: {inserted('z')}), lambda y: {inserted('y')})[1]"  # noqa: E731
    start = f"[CAST({{c: 0, a: '', t: '', n: 0}} AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR, n BIGINT)), {none}, {none}, {none}]"
    fold = closed("[" + ", ".join(edited(q) for q in range(4)) + "]")
    return rf"""
WITH checked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key, {crc_table} AS table_of
  FROM conversations
), drawn AS (
  SELECT conv_id, turn, role, text, {crc} % 20 AS d FROM checked
), rows AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM drawn WHERE d > 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM rows
), faults AS (
  SELECT *, NOT regexp_matches(text, '[^ 	-]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][ 	-]*$') AS open, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS two
  FROM ordered
), judged AS (
  SELECT *, NOT blank AND again AS duplicate, NOT blank AND NOT again AND open AS truncated FROM faults
), convs AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated,
         count_if(i > 1 AND two NOT IN ('su', 'ua', 'au')) AS illegal,
         list({{role: role, text: text, gone: blank OR duplicate, cut: CAST(truncated AS INT)}} ORDER BY i) AS rows
  FROM judged GROUP BY conv_id
), parsed AS (
  SELECT *, list_reduce(list_prepend(CAST(NULL AS STRUCT(role VARCHAR, text VARCHAR, gone BOOLEAN, cut INT)), rows)[2:], lambda s, r: {fold}, {closed(start)}) AS s FROM convs
), best AS (
  SELECT *, list_sort(list_filter([s[1], s[4]], lambda w: w.c IS NOT NULL))[1] AS b FROM parsed
)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit,
       sha256(coalesce(b.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN (SELECT conv_id AS id, * EXCLUDE (conv_id) FROM best) ON id IS NOT DISTINCT FROM conv_id
"""


@query("op13_conversation_repair", _repair_sql())
def conversation_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of each damaged conversation and its cheapest repair."""
    turns = table(spark, sf_dir, "conversations")
    columns = [F.col(c) for c in ("conv_id", "turn", "role", "text")]
    return conversation_repair.repair(conversation_repair.damaged(conversation_repair.plain_rows(turns, *columns)))
