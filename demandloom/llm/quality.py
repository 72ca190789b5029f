"""Quality rules: size and repetition, then divergence from language references.

Native: only DataFrame functions. A document is a row throughout, nothing is shuffled but the sums
that make the references.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules' characters and limits.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8

#: Common words of the languages that have a reference; the bins of the word histograms.
COMMON_WORDS = {
    "de": ("der", "die", "das", "und", "ist", "nicht", "mit", "von"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "with"),
    "es": ("el", "los", "que", "por", "se", "con", "las", "no"),
    "fr": ("le", "les", "des", "et", "une", "pour", "la", "du"),
}
#: Bins of the character histograms; characters of no class (letters beyond ASCII) are the last bin.
CHARACTER_CLASSES = {
    "a": "abcdefghijklmnopqrstuvwxyz",
    "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    " ": " \t\n\x0b\x0c\r",
    ".": "!\"'(),-./:;?@[\\]^_`{}~+=",
    "0": "0123456789",
    "#": SYMBOLS,
}


@dataclass(frozen=True)
class Limits:
    """Distances (0 to 1) beyond which a document is rejected, and the least sizes they are judged on."""

    char_distance: float = 0.3
    word_distance: float = 0.35
    min_chars: int = 200
    min_words: int = 50


def quoted(text: str) -> str:
    escapes = {"\\": "\\\\", "'": "\\'", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return "'" + "".join(escapes.get(c, c) for c in text) + "'"


def words_of(column: str) -> Column:
    """The words of a text: all between blanks and the ASCII controls tab to carriage return."""
    return F.array_remove(F.split(F.col(column), "[ \\t-\\r]+"), "")


def repeated_words(words: str, size: int = REPEAT_WINDOW) -> Column:
    """Words covered by windows of ``size`` words that the array holds twice or more.

    The windows' hashes are sorted with their places, equal neighbours mark places, and the gaps
    between marked places give the words covered. Without equal hashes nothing is sorted.
    """
    hashed = ", ".join(f"get(w, i + {k})" for k in range(size))
    return F.expr(f"""
        CASE WHEN size({words}) < {size} THEN 0L ELSE
        transform(array(transform(array({words}), w -> transform(sequence(0, size(w) - {size}), i -> xxhash64({hashed})))[0]), h ->
          CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE
          transform(array(array_sort(transform(h, (x, i) -> struct(x AS x, i AS i)))), s ->
          transform(array(array_sort(transform(filter(sequence(0, size(s) - 1), k -> coalesce(s[k].x = get(s, k - 1).x, false) OR coalesce(s[k].x = get(s, k + 1).x, false)), k -> s[k].i))), p ->
            aggregate(transform(p, (x, k) -> least({size}, coalesce(get(p, k + 1), x + {size}) - x)), 0L, (a, b) -> a + b))[0])[0] END)[0] END""")


def features(docs: DataFrame, text_col: str, deep: bool = True) -> DataFrame:
    """The input rows as struct ``source`` beside the counts that the rules and histograms need.

    ``chars`` are the characters of each class, ``common`` how often each common word occurs, with
    all other words in the last bin. ``deep`` adds the counts of repeated lines and windows.
    """
    classes = "".join(k * len(v) for k, v in CHARACTER_CLASSES.items())
    rows = docs.select(F.struct("*").alias("source"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.select("source", "t", words_of("t").alias("words"), F.translate("t", "".join(CHARACTER_CLASSES.values()), classes).alias("left_0"))
    for i, mark in enumerate(CHARACTER_CLASSES):  # the most frequent class first, so what is left gets short
        rows = rows.select("*", F.replace(f"left_{i}", F.lit(mark), F.lit("")).alias(f"left_{i + 1}"))
        rows = rows.select(*[c for c in rows.columns if c != f"left_{i}"], (F.length(f"left_{i}") - F.length(f"left_{i + 1}")).cast("long").alias(f"n_{i}"))
    last = len(CHARACTER_CLASSES)
    counts = [F.col(f"n_{i}") for i in range(last)] + [F.length(f"left_{last}").cast("long")]
    bins = [w for words in COMMON_WORDS.values() for w in words]
    listed = ", ".join(map(quoted, bins))
    rows = rows.select("source", "t", "words", F.array(*counts).alias("chars"), F.expr(f"filter(transform(words, w -> lower(w)), w -> w IN ({listed}))").alias("found"))
    per_word = [F.expr(f"size(filter(found, w -> w = {quoted(w)}))").cast("long") for w in bins]
    n_words = F.size("words").cast("long")
    made = ["source", n_words.alias("n_words"), "chars", F.array(*per_word, n_words - F.size("found")).alias("common")]
    if not deep:
        return rows.select(*made)
    marks = list(CHARACTER_CLASSES)
    word_chars = F.aggregate("chars", F.lit(0).cast("long"), lambda a, b: a + b) - F.get("chars", F.lit(marks.index(" ")))
    lines = "filter(split(t, '\\\\n'), l -> btrim(l, ' \\t\\r\x0b\x0c') != '')"
    rows = rows.select(
        *made,
        word_chars.alias("word_chars"),
        F.get("chars", F.lit(marks.index("#"))).alias("n_symbols"),
        F.expr(f"transform(array({lines}), l -> cast(size(l) - size(array_distinct(l)) AS bigint))[0]").alias("n_dup_lines"),
        repeated_words("words").alias("n_repeat_words"),
    )
    return rows


def shares(counts: str) -> Column:
    return F.expr(f"transform({counts}, c -> c / cast(aggregate({counts}, 0L, (a, b) -> a + b) AS double))")


def references(docs: DataFrame, text_col: str, lang_col: str) -> dict[str, tuple[list[float], list[float]]]:
    """Character and word histograms of each listed language, over all its documents.

    Languages without any word have no reference.
    """
    counted = features(docs, text_col, deep=False).select(F.col("source").getField(lang_col).alias("lang"), "chars", "common")
    kinds = {"chars": len(CHARACTER_CLASSES) + 1, "common": sum(map(len, COMMON_WORDS.values())) + 1}
    sums = [F.sum(F.get(k, F.lit(i)).cast("decimal(38,0)")).alias(f"{k}_{i}") for k, n in kinds.items() for i in range(n)]
    found = counted.filter(F.col("lang").isin(*COMMON_WORDS)).groupBy("lang").agg(*sums).collect()  # a row per listed language

    def share(row, kind: str) -> list[float]:
        values = [int(row[f"{kind}_{i}"]) for i in range(kinds[kind])]
        return [v / sum(values) for v in values]

    return {r["lang"]: (share(r, "chars"), share(r, "common")) for r in sorted(found, key=lambda r: r["lang"]) if any(r[f"common_{i}"] for i in range(kinds["common"]))}


def distance(counts: str, reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2) of an array of counts from a histogram; null without counts."""
    literal = "array(" + ", ".join(f"{x!r}D" for x in reference) + ")"
    half = "(CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / (p + q)) ELSE 0D END)"
    inner = f"({half.format('p')} + {half.format('q')}) / 2"
    total = f"cast(aggregate({counts}, 0L, (a, b) -> a + b) AS double)"
    summed = f"aggregate(zip_with(transform({counts}, c -> c / t), {literal}, (p, q) -> {inner}), 0D, (a, b) -> a + b)"
    return F.expr(f"transform(array({total}), t -> CASE WHEN t > 0 THEN sqrt(greatest(0D, {summed})) END)[0]")


def assess(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """The input rows as struct ``source``, with their counts, distances and verdict.

    ``char_distance`` and ``word_distance`` are the least Jensen-Shannon distances from the
    histograms of the listed languages, whatever language the row names. A document fails the
    method if it is long enough to be judged and lies beyond a limit; without references, as in an
    empty table or one of other languages, the base rules decide alone. Null and empty texts have
    no words and fail the base rules. Rows are judged one by one, so repeated rows, ties and null
    ids change nothing, and extra columns stay in ``source``.
    """
    known = references(docs, text_col, lang_col)
    rows = features(docs, text_col)

    def nearest(counts: str, kind: int) -> Column:
        found = [distance(counts, r[kind]) for r in known.values()]
        return F.array_min(F.array(*found)) if found else F.lit(None).cast("double")

    rows = rows.select("*", nearest("chars", 0).alias("char_distance"), nearest("common", 1).alias("word_distance"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    far_chars = (F.col("word_chars") >= limits.min_chars) & (F.coalesce("char_distance", F.lit(0.0)) > limits.char_distance)
    far_words = (F.col("n_words") >= limits.min_words) & (F.coalesce("word_distance", F.lit(0.0)) > limits.word_distance)
    return rows.select("*", base_failed.alias("base_failed"), (~base_failed & ~far_chars & ~far_words).alias("kept"))


def kept_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """The input rows that are kept, with the columns of the input.

    The row number keeps the filter above the counts: pushed below, it would repeat the expressions
    of every count it rests on.
    """
    judged = assess(docs, text_col, lang_col, limits).select("source", "kept", F.monotonically_increasing_id().alias("row"))
    return judged.filter((F.col("row") >= 0) & F.col("kept")).select(*[F.col("source").getField(c).alias(c) for c in docs.columns])
