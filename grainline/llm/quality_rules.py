"""Line-first cleaning with native expressions only.

Every line that has a word passes or fails three rules:

* punctuation: it ends with a sentence mark, optionally followed by closing quotes or brackets;
* navigation: it is no menu or breadcrumb trail (separators between short items);
* boilerplate: it is no short line with a stock phrase of page furniture (English, German, French, Spanish).

Failing lines go, the others are the cleaned text, and a document that loses more than
``max_lost`` of its characters is rejected. Everything is computed row by row in the JVM, so
there is no shuffle and no state beyond one text.

Cases: a null text counts as empty; a text without words has no lines, loses nothing and is
decided by the base rules (it fails them); repeated rows give repeated results; an empty table gives
no rows; other columns pass through ``clean``, but those named like its results are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Share of a document's line characters that may be removed.
MAX_LOST = 0.5
SYMBOLS = "#*$%&|<>"
SPACE = "[\\x20\\x09-\\x0D]"
ENDS_WELL = "[.!?…。！？][\"'”’»)\\]]*[\\x20\\x09-\\x0D]*$"
#: Three or more short items parted by menu separators. All but the bar stand between blanks, so that quotes
#: and the middle dots of words part nothing.
NAVIGATION = "^[^|»›·>]{0,40}(?:(?:\\||[ \\t][»›·>][ \\t])[^|»›·>]{0,40}){2,}$"
#: Stock phrases of page furniture, in lower case, and the longest line that one of them makes furniture: in a longer
#: one it is part of prose.
FURNITURE = 160
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "click here", "sign up for our newsletter", "subscribe to our", "skip to content",
    "lorem ipsum", "read more", "share this", "powered by",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "hier klicken", "weiterlesen", "zum inhalt springen",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "cliquez ici", "lire la suite", "aller au contenu",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "haga clic aquí", "leer más", "saltar al contenido",
)


def features(text) -> dict:
    """The base counts of a text column as expressions over helper columns made by ``clean``."""
    return {
        "n_words": F.size("_gl_words").cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_gl_lines") - F.size(F.array_distinct("_gl_lines"))).cast("long"),
    }


def clean(docs: DataFrame, text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """Adds the base counts, base_failed, n_lines, n_kept_lines, lost_share, clean_text and kept."""
    t = F.coalesce(F.col(text), F.lit(""))
    phrases = "(?iu)" + "|".join(BOILERPLATE)
    d = docs.withColumn("_gl_t", t)
    d = d.withColumn("_gl_words", F.expr(f"filter(split(_gl_t, '{_sql(SPACE)}+'), w -> w != '')"))
    d = d.withColumn("_gl_lines", F.expr("filter(split(_gl_t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
    # windows of three words by hash, sorted with their places, so that equal windows are neighbours
    d = d.withColumn(
        "_gl_sorted",
        F.expr(
            "case when size(_gl_words) >= 3 then sort_array(transform(sequence(0, size(_gl_words) - 3),"
            " i -> struct(xxhash64(get(_gl_words, i), get(_gl_words, i + 1), get(_gl_words, i + 2)) as h, i as i)))"
            " else array() end"
        ),
    )
    d = d.withColumn(
        "_gl_at",
        F.expr(
            "sort_array(transform(filter(_gl_sorted, (x, k) -> coalesce(x.h = get(_gl_sorted, k - 1).h, false)"
            " or coalesce(x.h = get(_gl_sorted, k + 1).h, false)), x -> x.i))"
        ),
    )
    d = d.withColumn(
        "_gl_passed",
        F.filter(
            "_gl_lines",
            lambda x: x.rlike(ENDS_WELL) & ~x.rlike(NAVIGATION) & ~((F.length(x) <= FURNITURE) & x.rlike(phrases)),
        ),
    )
    d = d.withColumns(
        features(F.col("_gl_t"))
        | {
            "n_repeat_words": F.expr(
                "aggregate(transform(_gl_at, (p, k) -> least(3, coalesce(get(_gl_at, k + 1) - p, 3))), 0, (a, x) -> a + x)"
            ).cast("long"),
            "n_lines": F.size("_gl_lines").cast("long"),
            "n_kept_lines": F.size("_gl_passed").cast("long"),
            "line_chars": F.length(F.array_join("_gl_lines", "")).cast("long"),
            "kept_chars": F.length(F.array_join("_gl_passed", "")).cast("long"),
            "clean_text": F.array_join("_gl_passed", "\n"),
        }
    )
    d = d.withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )
    # in whole numbers: max_lost as thousandths
    most = round(max_lost * 1000)
    lost = (F.col("line_chars") - F.col("kept_chars")) * 1000 > most * F.col("line_chars")
    return d.withColumn("kept", ~F.col("base_failed") & ~lost).drop(
        "_gl_t", "_gl_words", "_gl_lines", "_gl_sorted", "_gl_at", "_gl_passed"
    )


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\")


OUT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_kept_lines", "line_chars", "kept_chars", "kept"]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean(docs).select(*OUT)


_PHRASES = "|".join(BOILERPLATE).replace("'", "''")
_NAVIGATION = NAVIGATION.replace("\\t", "\\x09")
ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
b AS (
  SELECT rid, doc_id, t,
    list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM d),
w AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM b WHERE len(ws) >= 3),
g AS (SELECT rid, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS win FROM w),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM g) WHERE c > 1),
n AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
f AS (
  SELECT b.doc_id, len(ws) AS n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(n.n, 0) AS n_repeat_words, ls,
    list_filter(ls, lambda l: regexp_matches(l, '[.!?…。！？]["''”’»)\\]]*[\\x20\\x09-\\x0D]*$')
      AND NOT regexp_matches(l, '{_NAVIGATION}')
      AND NOT (length(l) <= {FURNITURE} AND regexp_matches(l, '(?i){_PHRASES}'))) AS ps
  FROM b LEFT JOIN n USING (rid)),
h AS (
  SELECT *, length(array_to_string(ls, '')) AS line_chars, length(array_to_string(ps, '')) AS kept_chars,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  len(ls)::BIGINT AS n_lines, len(ps)::BIGINT AS n_kept_lines, line_chars::BIGINT AS line_chars,
  kept_chars::BIGINT AS kept_chars,
  NOT base_failed AND NOT ((line_chars - kept_chars) * 1000 > {round(MAX_LOST * 1000)} * line_chars) AS kept
FROM h
"""
