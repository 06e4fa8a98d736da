"""Line-first cleaning with native expressions only.

Every line of a text is judged on its own: punctuation (shouting marks, symbol
noise), navigation (separator lists, short lines without an end mark) and
boilerplate (licence, cookie and script notices). Failing lines are removed,
and a document that loses more than ``MAX_LOST_PCT`` percent of its word
characters is rejected. Word statistics of the whole text (repeated lines and
repeated three-word windows) are computed in the row, with array functions:
nothing is exploded or shuffled.

Windows: each window's hash with its place in the low bits is one long; the
longs are sorted and equal neighbours are candidates; candidates are then
compared by their words, so the count does not depend on the hash.

Cases: a null or empty text, or one of blanks only, has no words, counts 0,
fails the base rule and is not kept; lines without a word are never counted
nor judged; repeated rows are judged one by one; a null id stays null; columns
of the input other than id and text are ignored by ``judge`` and kept by
``clean_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ASCII blanks, symbol characters, limits of the base rule.
BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
# Line rules.
SHOUT_MARKS = 3
WORDS_PER_SYMBOL = 5
SEPARATORS = r"[|»›•·]"
MIN_SEPARATORS = 3
WORDS_PER_SEPARATOR = 4
SHORT_LINE_WORDS = 6
END_MARK = r"[.!?:;…。！？)\]\x22”’']" + BLANK + r"*$"
BOILERPLATE = (r"(?i)all rights reserved|licen[sc]ed under|released under the|terms (of|and) (use|service|conditions)"
               r"|privacy policy|cookie policy|use of cookies|enable javascript|lorem ipsum|click here"
               r"|sign up for|subscribe to (our|the)|skip to (main )?content|back to top")
# A boilerplate phrase counts in lines of at most so many words; in a longer one it is prose.
BOILERPLATE_WORDS = 40
# Share of the word characters that removed lines may hold.
MAX_LOST_PCT = 50


def n_words(s: Column) -> Column:
    return F.regexp_count(s, F.lit(r"[^\x20\x09-\x0D]+"))


def line_fails(line: Column, words: Column) -> Column:
    """Whether a line with ``words`` words fails a rule."""
    symbols, separators = F.regexp_count(line, F.lit("[#*$%&<>]")), F.regexp_count(line, F.lit(SEPARATORS))
    return ((F.regexp_count(line, F.lit("!!")) >= SHOUT_MARKS)
            | (symbols * WORDS_PER_SYMBOL > words)
            | ((separators >= MIN_SEPARATORS) & (separators * WORDS_PER_SEPARATOR >= words))
            | ((words < SHORT_LINE_WORDS) & ~line.rlike(END_MARK))
            | ((words <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE)))


def failing(text: Column, keep_if) -> Column:
    """Lines of a text for which ``keep_if(fails, words)`` holds, in order."""
    counted = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("l"), n_words(x).alias("n")))
    chosen = F.filter(counted, lambda x: keep_if(line_fails(x["l"], x["n"]), x["n"]))
    return F.transform(chosen, lambda x: x["l"])


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def word_chars(s: Column) -> Column:
    return F.char_length(s) - F.regexp_count(s, F.lit(BLANK))


def packed_windows(words: Column, n: Column, bits: Column) -> Column:
    """Sorted longs, one per three-word window: hash above, place in the low ``bits``."""
    at = F.sequence(F.lit(0), n - 3)
    packed = F.transform(at, lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])
                         .bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("bigint"), bits)).bitwiseOR(i.cast("bigint")))
    return F.when(n >= 3, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>"))


def same_neighbour(arr: Column, key) -> Column:
    """Elements of a sorted array that share their key with a neighbour."""
    return F.filter(arr, lambda x, j: F.coalesce(key(x) == key(F.get(arr, j + 1)), F.lit(False))
                    | F.coalesce(key(x) == key(F.get(arr, j - 1)), F.lit(False)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, kept."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    a = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), has_word)
    a = a.withColumns({
        "words": F.filter(F.split("text", BLANK + "+"), lambda w: w != ""), "lines": lines,
        "n_symbols": F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint"),
        "word_chars": word_chars(F.col("text")).cast("bigint")})
    a = a.withColumns({
        "n": F.size("words"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
        "lost_chars": word_chars(F.array_join(failing(F.col("text"), lambda bad, n: (n > 0) & bad), "")).cast("bigint")})
    a = a.drop("text", "lines").withColumn("bits", F.length(F.bin("n")))
    a = a.withColumn("packed", packed_windows(F.col("words"), F.col("n"), F.col("bits")))
    high = lambda x: F.call_function("shiftright", x, F.col("bits"))
    a = a.withColumn("packed", same_neighbour(F.col("packed"), high))
    low = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bits")) - 1).cast("int")
    w = F.col("words")
    a = a.withColumn("twins", F.sort_array(F.transform("packed", lambda x: F.struct(
        F.concat_ws(" ", w[low(x)], w[low(x) + 1], w[low(x) + 2]).alias("s"), low(x).alias("p")))))
    a = a.drop("words", "packed")
    a = a.withColumn("places", F.sort_array(F.transform(
        same_neighbour(F.col("twins"), lambda x: x["s"]), lambda x: x["p"])))
    places = F.col("places")
    covered = F.aggregate(F.transform(places, lambda p, j: F.least(
        F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3)))), F.lit(0), lambda x, y: x + y)
    a = a.withColumn("n_repeat_words", covered.cast("bigint")).withColumn("n_words", F.col("n").cast("bigint"))
    a = a.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                     | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))
    return a.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    "lost_chars", (~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST_PCT * F.col("word_chars")))
                    .alias("kept"))


def clean_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every text without its failing lines (null stays null); all columns are kept."""
    good = failing(F.col(text_col), lambda bad, n: (n == 0) | ~bad)
    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.array_join(good, "\n")))


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# The same counts and verdict for the DuckDB check, over one row per word and one per line.
QUALITY_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
      FROM (SELECT r, regexp_extract_all(t, {_sql(r"[^\x20\x09-\x0D]+")}) AS ws FROM d)),
g AS (SELECT r, i, w, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM x WINDOW p AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w2, w3) > 1 AS twin, length(w) AS k FROM g),
f AS (SELECT r, k, twin OR coalesce(lag(twin, 1) OVER q, false) OR coalesce(lag(twin, 2) OVER q, false) AS hit
      FROM c WINDOW q AS (PARTITION BY r ORDER BY i)),
words AS (SELECT r, count(*) AS n_words, sum(k) AS word_chars, sum(hit::INT) AS n_repeat_words FROM f GROUP BY r),
l AS (SELECT r, l, len(regexp_extract_all(l, {_sql(r"[^\x20\x09-\x0D]+")})) AS n,
             length(regexp_replace(l, {_sql(BLANK)}, '', 'g')) AS k
      FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)),
j AS (SELECT r, l, k,
        len(regexp_extract_all(l, '!!')) >= {SHOUT_MARKS}
        OR len(regexp_extract_all(l, '[#*$%&<>]')) * {WORDS_PER_SYMBOL} > n
        OR (len(regexp_extract_all(l, {_sql(SEPARATORS)})) >= {MIN_SEPARATORS}
            AND len(regexp_extract_all(l, {_sql(SEPARATORS)})) * {WORDS_PER_SEPARATOR} >= n)
        OR (n < {SHORT_LINE_WORDS} AND NOT regexp_matches(l, {_sql(END_MARK)}))
        OR (n <= {BOILERPLATE_WORDS} AND regexp_matches(l, {_sql(BOILERPLATE)})) AS bad
      FROM l WHERE n > 0),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines, sum(CASE WHEN bad THEN k ELSE 0 END) AS lost FROM j GROUP BY r),
a AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
        len(regexp_extract_all(t, {_sql(SYMBOLS)}))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        coalesce(lost, 0) AS lost
      FROM d LEFT JOIN words USING (r) LEFT JOIN lines USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * lost <= {MAX_LOST_PCT} * word_chars AS kept
FROM b
"""
