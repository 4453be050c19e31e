"""Operator 6: secret scans by patterns and sliding-window entropy, in DataFrame and SQL expressions only.

A pattern's spans come from the gaps that split() leaves and the matches that regexp_extract_all() gives. Candidate strings
of a character class become spans if some window of theirs has high Shannon entropy, kept by counts that change by the one
character that enters and the one that leaves, unless the allow list knows what they are. Windows lie between sample values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_runs

#: Fixed patterns: kind -> (pattern, group whose length counts, least length), in the order in which kinds are listed.
BASE = {
    "assign": (r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
#: Character classes of candidates: kind -> (alphabet, characters in a window, least bits a character).
CLASSES = {
    "entropy64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 24, 4.0),
    "entropy16": ("0123456789ABCDEFabcdef", 16, 2.8),
}
KINDS = [*BASE, *CLASSES]
#: Sample values. A window that holds one is not counted.
SAMPLE = r"(?i:example|sample|placeholder|changeme|dummy|x{6}|abcdef|012345|123456)"
#: What may stand between - _ / +: letters of one case, camel-case words of 2 to 15 letters, and up to 4 digits. It ends where the letters and digits do.
PART = r"(?:[A-Za-z]?[a-z]+|[A-Z]+|[A-Z]?[a-z]{2,15}(?:[A-Z][a-z]{2,15}){1,5}|[0-9]{1,4})(?![A-Za-z0-9])"
#: Candidates that are no secrets: numbers, such parts, and sample values with no room for a window before, between or after them.
#: Groups repeat possessively: Java matches that in a loop, and other repeated groups by recursion, which ends its stack on long candidates.
LEAST = min(window for _, window, _ in CLASSES.values())
ALLOWED = rf"^[0-9]+$|^[-_/+]*+{PART}(?:[-_/+]++{PART})*+[-_/+]*+$|^(?:.{{0,{LEAST - 1}}}?{SAMPLE})++.{{0,{LEAST - 1}}}$"

SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Matches that are located, and characters that are cut, at a time.
BLOCK, PAGE = 256, 4096


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _prefilter(kind: str) -> str:
    """A pattern that every text with a span of this kind matches, quick to refuse others."""
    if kind in CLASSES:
        alphabet, window, _ = CLASSES[kind]
        letters = _class(alphabet)
        return f"(?<![{letters}])[{letters}]{{{window}}}"
    return {"access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}.get(kind, BASE[kind][0])


def _class(alphabet: str) -> str:
    return alphabet.replace("-", "\\-")


def _located(pattern: str, group: int) -> str:
    """array<struct<start, end, hit>> of all matches in text, leftmost and not overlapping: starts from the lengths of what
    lies between matches, summed in blocks so that the work stays near the number of matches."""
    p = _quoted(pattern)
    sizes = "transform(z.m, (x, i) -> struct(length(z.gaps[i]) as gap, length(x) as size, z.hit[i] as hit))"
    grow = "struct(a.at + x.gap + x.size as at, concat(a.out, array(struct(a.at + x.gap as start, a.at + x.gap + x.size as end, x.hit as hit))) as out)"
    kind = "array<struct<start:int,end:int,hit:string>>"
    block = f"aggregate(slice(s, b * {BLOCK} + 1, {BLOCK}), struct(0 as at, cast(array() as {kind}) as out), (a, x) -> {grow})"
    blocks = f"transform(sequence(0, (size(s) - 1) div {BLOCK}), b -> {block})"
    moved = "transform(x.out, y -> struct(a.at + y.start as start, a.at + y.end as end, y.hit as hit))"
    joined = f"aggregate({blocks}, struct(0 as at, cast(array() as {kind}) as out), (a, x) -> struct(a.at + x.at as at, concat(a.out, {moved}) as out), a -> a.out)"
    found = f"struct(split(text, '{p}') as gaps, regexp_extract_all(text, '{p}', 0) as m, regexp_extract_all(text, '{p}', {group}) as hit)"
    return f"transform(array({found}), z -> transform(array({sizes}), s -> case when size(s) = 0 then cast(array() as {kind}) else {joined} end)[0])[0]"


def _best_entropy(s: str, alphabet: str, window: int) -> str:
    """The highest entropy, in bits a character, of the windows of string s. State: the counts by letter of the alphabet,
    the sum of c * log2(c) over them, and the least sum so far of a whole window."""
    weight = "array(" + ", ".join(f"{c * math.log2(c) if c else 0.0!r}D" for c in range(window + 1)) + ")"
    letters = f"transform(split({s}, ''), x -> instr('{alphabet}', x) - 1)"
    counts = f"array_repeat(0, {len(alphabet)})"
    gone = f"case when i >= {window} then l[i - {window}] else -1 end"
    # In and out of the same letter leaves the counts as they are.
    total = "case when x.into = x.out then a.total else a.total + w[a.c[x.into] + 1] - w[a.c[x.into]] + case when x.out < 0 then 0D else w[a.c[x.out] - 1] - w[a.c[x.out]] end end"
    step = f"struct(case when x.into = x.out then a.c else transform(a.c, (c, k) -> c + case when k = x.into then 1 when k = x.out then -1 else 0 end) end as c, {total} as total)"
    least = f"struct(y.c as c, y.total as total, case when x.i >= {window - 1} then least(a.least, y.total) else a.least end as least)"
    start = f"struct({counts} as c, 0D as total, 1e9D as least)"
    moves = f"transform(l, (x, i) -> struct(x as into, {gone} as out, i as i))"
    fold = f"aggregate({moves}, {start}, (a, x) -> transform(array({step}), y -> {least})[0], a -> log2({window}) - a.least / {window})"
    return f"transform(array({letters}), l -> transform(array({weight}), w -> {fold})[0])[0]"


def spans() -> Column:
    """array<struct<start, kind, end>> of all secrets in the column text, which is not null, by start, then kind as listed (an index into KINDS).

    Code points, end exclusive. A string may be found by more than one kind.
    """
    parts = []
    for k, kind in enumerate(KINDS):
        if kind in BASE:
            pattern, group, least = BASE[kind]
            found, wanted = _located(pattern, group), f"length(x.hit) >= {least}"
        else:
            alphabet, window, bits = CLASSES[kind]
            found = _located(f"[{_class(alphabet)}]+", 0)
            free = f"exists(split(x.hit, '{_quoted(SAMPLE)}'), part -> case when length(part) < {window} then false else {_best_entropy('part', alphabet, window)} >= {bits}D end)"
            wanted = f"case when length(x.hit) < {window} or x.hit rlike '{_quoted(ALLOWED)}' then false else {free} end"
        kept = f"transform(filter({found}, x -> {wanted}), x -> struct(x.start as start, {k} as kind, x.end as end))"
        parts.append(f"case when text rlike '{_quoted(_prefilter(kind))}' then {kept} else cast(array() as {SPAN}) end")
    return F.expr(f"sort_array(concat({', '.join(parts)}))")


def _with_spans(docs: DataFrame, *more: str) -> DataFrame:
    text = docs.select(*[docs[c] for c in more], docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    # The condition always holds. Being undetermined for the optimiser, it keeps the spans from being computed at each use.
    return text.withColumn("spans", F.when(F.monotonically_increasing_id() >= 0, spans()))


def _listed(array: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({array}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')"


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every whole text.

    spans lists kind:start:end by start, then kind as listed; base_sha256 is of the base kinds alone. Null or empty text:
    0, the digest of nothing, and ''. Repeated rows each give a row; a null doc_id stays null; other columns are left
    behind. Candidates of a million characters are scanned whole. Empty table: no rows.
    """
    base = f"filter(spans, x -> x.kind < {len(BASE)})"
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = {k})) as bigint)").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return _with_spans(docs).select("doc_id", *counts, F.expr(f"sha2({_listed(base)}, 256)").alias("base_sha256"), F.expr(_listed("spans")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs, all columns, with each run of overlapping or touching spans in text replaced by mark, and n_chars (if there) counted again.

    A null text stays null and an empty one empty. Null ids and repeated rows are kept, row by row; candidates and texts of a
    million characters are masked whole; columns may have any names. Empty table: no rows.
    """
    whole = docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    # What stays is taken from pages of the text, as a substring costs as much as what lies before it.
    page = lambda at: f"coalesce(get(z.pages, {at} div {PAGE}), '')"
    within = f"substring({page('p.start')}, p.start % {PAGE} + 1, p.end - p.start)"
    across = f"concat(substring({page('p.start')}, p.start % {PAGE} + 1), array_join(slice(z.pages, p.start div {PAGE} + 2, p.end div {PAGE} - p.start div {PAGE} - 1), ''), substring({page('p.end')}, 1, p.end % {PAGE}))"
    piece = f"case when p.start div {PAGE} = p.end div {PAGE} then {within} else {across} end"
    bounds = "concat(transform(z.runs, (x, i) -> struct(case when i = 0 then 0 else z.runs[i - 1].end end as start, x.start as end)), array(struct(element_at(z.runs, -1).end as start, z.size as end)))"
    cut = f"concat_ws('{mark}', transform({bounds}, p -> {piece}))"
    parts = f"struct({joined_runs('spans')} as runs, regexp_extract_all(text, '(?s).{{1,{PAGE}}}', 0) as pages, length(text) as size)"
    clean = f"case when size(spans) = 0 then text else transform(array({parts}), z -> {cut})[0] end"
    out = _with_spans(whole, "_row").withColumn("clean", F.expr(clean)).withColumn("clean", F.when(F.col("_row.text").isNotNull(), F.col("clean")))
    changed = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return out.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
