"""Operator 5: quality rules as a short-circuit cascade, in DataFrame and SQL expressions only.

Counts of words, symbols, repeated lines and repeated words are taken of every text. Further rules run in an order found on
a sample: the rule that rejects most for its cost first, so that most rejected texts never meet the costly ones.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

WHITE = r" \t\n\u000B\u000C\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
#: Per cent of words that may lie in windows of WINDOW words found more than once.
MAX_REPEATED = 20
WINDOW = 5
#: Rows of the sample on which rules are timed; it decides their order, never what they reject.
SAMPLE_ROWS = 2000

#: Rules beyond the base: name -> condition for rejection, over text, words, n_lines and the base counts.
RULES = {
    "symbols": "100 * n_symbols > 10 * n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "repeated_lines": "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines",
    "shouting": r"100 * regexp_count(text, '\\p{Lu}') > 30 * word_chars",
    "few_letters": r"100 * size(filter(words, x -> x rlike '\\p{L}')) < 50 * n_words",
}


def _with_words(docs: DataFrame, *more: str) -> DataFrame:
    text = docs.select(*[docs[c] for c in more], docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    bare = f"btrim(text, '{WHITE}')"
    return text.withColumns(
        {
            "words": F.expr(f"case when {bare} = '' then cast(array() as array<string>) else split({bare}, '[ \\\\t-\\\\r]+') end"),
            "lines": F.expr(f"filter(split(text, '\\n'), x -> btrim(x, '{WHITE}') <> '')"),
        }
    )


def _repeated(hashes: str) -> str:
    """Words covered by the windows whose hash occurs twice or more; an expression over an array of hashes by first word."""
    pairs = f"sort_array(transform({hashes}, (x, i) -> struct(x as h, i as i)))"
    twice = "filter(s, (x, i) -> (i > 0 and s[i - 1].h = x.h) or (i + 1 < size(s) and s[i + 1].h = x.h))"
    places = f"transform(array({pairs}), s -> sort_array(transform({twice}, x -> x.i)))[0]"
    return f"aggregate({places}, struct(-{WINDOW} as last, 0 as n), (a, x) -> struct(x as last, a.n + least({WINDOW}, x - a.last) as n), a -> a.n)"


def base_counts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text, words, n_lines and the base counts of every document; `more` names columns to carry along."""
    window = ", ".join(f"words[i + {k}]" for k in range(WINDOW))
    counted = _with_words(docs, *more).withColumns(
        {
            "n_words": F.expr("size(words)"),
            "word_chars": F.expr("length(concat_ws('', words))"),
            "n_symbols": F.expr(f"regexp_count(text, '[{SYMBOLS}]')"),
            "n_lines": F.expr("size(lines)"),
            "n_dup_lines": F.expr("size(lines) - size(array_distinct(lines))"),
            "hashes": F.expr(f"case when size(words) < {WINDOW} then cast(array() as array<bigint>) else transform(sequence(0, size(words) - {WINDOW}), i -> xxhash64({window})) end"),
        }
    )
    # The first case never holds. Being undetermined for the optimiser, it keeps a later filter from moving below this
    # projection, where every use of words or hashes would become a computation of its own, some of them inside lambdas.
    repeated = f"case when monotonically_increasing_id() < 0 then null when size(array_distinct(hashes)) = size(hashes) then 0 else {_repeated('hashes')} end"
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return counted.withColumn("n_repeat_words", F.expr(repeated)).select(*more, "doc_id", "text", "words", "n_lines", *[F.col(c).cast("long").alias(c) for c in counts])


BASE_FAILED = f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words"


def rule_order(docs: DataFrame, rules: dict[str, str] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[tuple[str, float, float]]:
    """(rule, share rejected of what the rules before it leave, seconds) on a sample, by such rejections per second.

    A rule's seconds are those of a job over the sample beyond a job with an empty rule. Which rules reject a row together
    comes from one more job. An empty table gives the rules as listed.
    """
    total = docs.count()
    if not total:
        return [(name, 0.0, 0.0) for name in rules]
    sample = stored(base_counts(docs.sample(min(1.0, sample_rows / total), seed)).where(f"not ({BASE_FAILED})"))
    def seconds(rule: str) -> float:
        took = []
        for _ in range(2):  # the first compiles
            began = time.perf_counter()
            sample.agg(F.count_if(F.expr(rule))).first()
            took.append(time.perf_counter() - began)
        return min(took)

    empty = seconds("n_words < 0")
    cost = {name: max(1e-3, seconds(rule) - empty) for name, rule in rules.items()}
    hits = F.array(*[F.coalesce(F.expr(rule), F.lit(False)) for rule in rules.values()])
    left = [(dict(zip(rules, r[0], strict=True)), r[1]) for r in sample.groupBy(hits.alias("hits")).count().collect()]  # at most 2 to the number of rules
    discard(sample)
    order = []
    while len(order) < len(rules):
        rows = max(1, sum(n for _, n in left))
        rest = {name: sum(n for hit, n in left if hit[name]) / rows for name in rules if name not in [x[0] for x in order]}
        best = max(rest, key=lambda name: (rest[name] / cost[name], -cost[name]))
        order.append((best, rest[best], cost[best]))
        left = [(hit, n) for hit, n in left if not hit[best]]
    return order


def judged(docs: DataFrame, *more: str, rules: dict[str, str] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """base_counts with base_failed, kept and rejected_by (the first rule in the order run that rejects; null if kept)."""
    order = [name for name, _, _ in rule_order(docs, rules, sample_rows)]
    steps = " ".join(f"when {rules[name]} then '{name}'" for name in order)
    base = base_counts(docs, *more).withColumn("base_failed", F.expr(BASE_FAILED))
    return base.withColumn("rejected_by", F.expr(f"case when base_failed then 'base' {steps} end")).withColumn("kept", F.col("rejected_by").isNull())


def quality(docs: DataFrame, rules: dict[str, str] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every document.

    Null or empty text: no words, so it fails. Texts are judged whole, however long. Repeated rows each give a row; a null doc_id stays null; other columns, whatever
    their names, are left behind. Empty table: no rows.
    """
    return judged(docs, rules=rules, sample_rows=sample_rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def kept_documents(docs: DataFrame, rules: dict[str, str] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, all columns, that no rule rejects.

    A null or empty text has no words and goes. Null ids and repeated rows are judged row by row; long texts whole; columns may
    have any names. Empty table: no rows.
    """
    # The original columns travel as one struct, so that none clashes with the counts.
    whole = docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    return judged(whole, "_row", rules=rules, sample_rows=sample_rows).where("kept").select("_row.*")


#: The same rules in DuckDB SQL. Its windows are compared word by word, without a hash.
ORACLE = r"""
with t as (select doc_id, coalesce("text", '') as txt from documents),
w as (select doc_id, txt, regexp_extract_all(txt, '[^\x20\x09-\x0D]+') as words,
        list_filter(string_split(txt, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
u as (select doc_id, unnest(words) as x, unnest(range(1, len(words) + 1)) as i from w where len(words) >= 5),
g as (select doc_id, i, x, lead(x, 1) over v as x1, lead(x, 2) over v as x2, lead(x, 3) over v as x3, lead(x, 4) over v as x4
      from u window v as (partition by doc_id order by i)),
h as (select doc_id, i, count(*) over (partition by doc_id, x, x1, x2, x3, x4) as c from g where x4 is not null),
p as (select doc_id, i, lag(i) over (partition by doc_id order by i) as b from h where c > 1),
r as (select doc_id, sum(least(5, i - coalesce(b, i - 5))) as n from p group by doc_id),
b as (select w.doc_id, txt, words, len(lines) as n_lines, cast(len(words) as bigint) as n_words,
        cast(length(array_to_string(words, '')) as bigint) as word_chars,
        cast(len(regexp_extract_all(txt, '[#*$%&|<>]')) as bigint) as n_symbols,
        cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
        cast(coalesce(r.n, 0) as bigint) as n_repeat_words
      from w left join r on w.doc_id is not distinct from r.doc_id),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed
    or 100 * n_symbols > 10 * n_words
    or word_chars < 2 * n_words or word_chars > 15 * n_words
    or (n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines)
    or 100 * len(regexp_extract_all(txt, '\p{Lu}')) > 30 * word_chars
    or 100 * len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) < 50 * n_words) as kept
from f
"""
