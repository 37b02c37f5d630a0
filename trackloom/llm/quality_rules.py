"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression, so that the whole operator is one scan without a shuffle and without user functions.

Defined results
* null, empty or blank text: no words, all counts 0, `base_failed` true, `kept` false.
* very long text: the whole text is measured; the repeated windows are found by sorting, never by comparing all pairs.
* repeated rows: each is judged on its own. Empty table: an empty result. Further columns of the input do not matter.
* Windows of five words are compared by their 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, read_table, words_of

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that for it was on with be by this as an are at from or "
    "der die und das von mit ist den des ein eine zu im für sie nicht "
    "de la le les et des du un une en que pas pour dans sur qui est "
    "el los las del y por con para una su se lo no al"
).split()
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document passes if `measure` lies within [low, high]; a null measure passes."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The method's own thresholds. They are wide: a rule is to catch rubbish, not odd prose.
RULES = (
    Rule("word_length", "mean_word_length", 2.0, 25.0),
    Rule("symbols", "symbols_per_word", None, 0.3),
    Rule("line_copies", "dup_line_ratio", None, 0.5),
    Rule("stop_words", "stop_word_ratio", 0.01, None, min_words=100),
    Rule("letters", "letter_char_ratio", 0.5, None),
    Rule("exclamations", "exclamation_ratio", None, 0.5, min_words=20),
    Rule("one_word", "distinct_word_ratio", 0.02, None, min_words=50),
)


def _measures(text: Column) -> dict[str, Column]:
    """Counts that need no other measure."""
    return {
        "_words": words_of(text),
        "_n_chars": F.length(text),
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_exclamations": (F.length(text) - F.length(F.translate(text, "!¡", ""))).cast("long"),
        "n_non_letters": F.length(F.regexp_replace(text, r"[\p{L}\p{M}\x20\x09-\x0D]+", "")).cast("long"),
        "_lines": F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, BLANKS, "")) > 0),
    }


def _window_hashes(words: Column) -> Column:
    last = F.size(words) - WINDOW
    return F.when(last >= 1, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])))


def _sorted_repeats(hashes: Column) -> Column:
    """(hash, place) of all windows in order of hash, only if any hash occurs twice."""
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.array_sort(pairs))


def _repeat_places(ordered: Column) -> Column:
    def twice(x: Column, i: Column) -> Column:
        before, after = F.get(ordered, i - 1)["h"], F.get(ordered, i + 1)["h"]
        return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))

    return F.sort_array(F.transform(F.filter(ordered, twice), lambda x: x["i"]))


def _covered(places: Column) -> Column:
    """Words that lie in a window starting at one of the places, which are in order."""
    steps = F.transform(places, lambda p, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(places, i - 1))))
    return F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x), F.lit(0).cast("long"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def document_measures(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The counts and ratios that the rules speak of, one row a document."""
    text = F.coalesce(F.col("_t"), F.lit(""))
    base = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_t"))
    base = base.select(*keep, *[c.alias(n) for n, c in _measures(text).items()])
    base = base.withColumns({
        "n_words": F.size("_words").cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_stops": F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))),
        "_distinct": F.size(F.array_distinct("_words")),
        "_hashes": _window_hashes(F.col("_words")),
    })
    base = base.withColumn("_ordered", _sorted_repeats(F.col("_hashes")))
    base = base.withColumn("_places", _repeat_places(F.col("_ordered")))
    words = F.col("n_words")
    return base.withColumns({
        "n_repeat_words": _covered(F.col("_places")),
        "mean_word_length": _ratio(F.col("word_chars"), words),
        "symbols_per_word": _ratio(F.col("n_symbols"), words),
        "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
        "stop_word_ratio": _ratio(F.col("_stops"), words),
        "letter_char_ratio": _ratio(F.col("word_chars") - F.col("n_non_letters"), F.col("word_chars")),
        "exclamation_ratio": _ratio(F.col("n_exclamations"), words),
        "distinct_word_ratio": _ratio(F.col("_distinct"), words),
    })


def compile_rules(rules=RULES) -> Column:
    """One boolean expression for the whole table: true if every rule passes."""
    passed = F.lit(True)
    for rule in rules:
        value, ok = F.col(rule.measure), F.lit(True)
        if rule.low is not None:
            ok = ok & (value >= rule.low)
        if rule.high is not None:
            ok = ok & (value <= rule.high)
        passed = passed & (F.coalesce(ok, F.lit(True)) | (F.col("n_words") < rule.min_words))
    return passed


def judge(docs: DataFrame, rules=RULES, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """All measures with `base_failed` and the verdict `kept`."""
    measured = document_measures(docs, text_col, keep)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & compile_rules(rules))


def keep_good(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their own columns only."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{text_col}`").alias("_text"))
    judged = judge(whole, rules, "_text", ("_doc",)).select("_doc", "kept", F.monotonically_increasing_id().alias("_row"))
    # the row number keeps the filter above the projection: pushed down, it would hold all measures several times over
    return judged.filter((F.col("_row") >= 0) & F.col("kept")).select("_doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_IN_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
SQL = rf"""
with base as (
  select doc_id, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls
  from documents),
wide as (
  select *, len(ws) as n, case when len(ws) > {WINDOW} then list_transform(range(1, len(ws) - {WINDOW} + 2), lambda i: list_aggregate(ws[i : i + {WINDOW - 1}], 'string_agg', ' ')) else [] end as g
  from base),
grams as (select rowid_, unnest(g) as x, unnest(range(len(g))) as p from (select row_number() over () as rowid_, g, doc_id from wide)),
twice as (select rowid_, p from (select rowid_, p, count(*) over (partition by rowid_, x) as c from grams) where c > 1),
covered as (select rowid_, count(distinct p + k) as r from twice, range({WINDOW}) as o(k) group by rowid_),
numbered as (select row_number() over () as rowid_, * from wide),
m as (
  select doc_id, n::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (length(t) - length(regexp_replace(t, '[!¡]', '', 'g')))::bigint as n_ex,
    length(regexp_replace(t, '[\pL\pM\x20\x09-\x0D]', '', 'g'))::bigint as n_non,
    len(ls) as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(r, 0)::bigint as n_repeat_words,
    len(list_filter(ws, lambda w: lower(w) in ({_IN_STOPS}))) as stops, len(list_distinct(ws)) as dist
  from numbered left join covered using (rowid_)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed
  and word_chars / n_words between 2.0 and 25.0
  and n_symbols / n_words <= 0.3
  and n_dup_lines / n_lines <= 0.5
  and (n_words < 100 or stops / n_words >= 0.01)
  and (word_chars - n_non) / word_chars >= 0.5
  and (n_words < 20 or n_ex / n_words <= 0.5)
  and (n_words < 50 or dist / n_words >= 0.02) as kept
from b
"""
