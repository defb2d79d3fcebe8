"""Quality rules as a short-circuit cascade, in DataFrame functions only.

The base measures of every text come first: words, their code points, symbols, repeated
lines and words inside repeated three-word windows.  Then the rules of RULES follow, each
with its own measure of the whole text.  A bounded sample (SAMPLE_ROWS rows, the only
bound; nothing but the order of rules depends on it) gives each rule's share of rejected
rows and the seconds it takes; rules are ordered by rejection per cost and become the
branches of one CASE, so a text that fails a rule pays for none of those behind it.  The
verdict is that of all rules together, whatever their order.

Windows are told apart by XXH64 over their three words (two different windows of one text
of n words agree with a probability below n * n / 2**65).  No row leaves its partition.

Defined results: null and empty texts have no words and fail the base; repeated rows are
judged alike, each by its own text; a null doc_id is kept as it is; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import stored

SAMPLE_ROWS = 2000
TRIALS = 2
LEAST_WORDS = 50
MOST_REPEATED = 50  # of 100 words

# True: the text is rejected.  Columns: text, words, lines (those with a word) and the base measures.
RULES = {
    "symbols": "100 * n_symbols > 10 * n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 14 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * size(lines)",
    "capitals": "100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 40 * word_chars",
    "exclamations": "100 * (length(text) - length(translate(text, '!?', ''))) > 30 * n_words",
    "same_neighbours": """100 * size(filter(zip_with(slice(words, 1, size(words) - 1), slice(words, 2, size(words)),
        (a, b) -> a = b), same -> same)) > 20 * n_words""",
    "letters": r"100 * size(filter(words, w -> w rlike '\\p{L}')) < 70 * n_words",
    "ellipses": r"100 * size(filter(lines, l -> l rlike '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$')) > 30 * size(lines)",
    "bullets": r"100 * size(filter(lines, l -> l rlike '^[\\x20\\x09-\\x0D]*[-*•]')) > 90 * size(lines)",
}


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text, words, lines and the base measures of each row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.selectExpr(
        "doc_id",
        "text",
        r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '') as words",
        r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]') as lines",
    )
    rows = rows.selectExpr(
        "*",
        r"cast(length(translate(text, ' \t\n\u000B\u000C\r', '')) as bigint) as word_chars",
        "cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols",
        "cast(size(lines) - size(array_distinct(lines)) as bigint) as n_dup_lines",
        """transform(slice(words, 1, greatest(size(words) - 2, 0)),
            (w, i) -> xxhash64(w, words[i + 1], words[i + 2])) as windows""",
    )
    # Windows in the order of their hashes, where any of them repeats; then the starts of those that do.
    rows = rows.withColumn(
        "windows",
        F.expr("""if(size(array_distinct(windows)) = size(windows), null,
            sort_array(transform(windows, (h, i) -> struct(h as h, i as i))))"""),
    )
    rows = rows.withColumn(
        "windows",
        F.expr("""sort_array(transform(filter(windows, (e, k) ->
            k > 0 and windows[greatest(k - 1, 0)].h = e.h
            or k + 1 < size(windows) and windows[least(k + 1, size(windows) - 1)].h = e.h), e -> e.i))"""),
    )
    # A start covers three words, or those up to the next start.
    covered = """coalesce(aggregate(zip_with(windows, slice(windows, 2, size(windows)),
        (a, b) -> least(3, coalesce(b - a, 3))), 0L, (s, x) -> s + x), 0L)"""
    return rows.selectExpr(
        "doc_id", "text", "words", "lines", "cast(size(words) as bigint) as n_words", "word_chars", "n_symbols",
        "n_dup_lines", f"{covered} as n_repeat_words",
    ).withColumn(
        "base_failed",
        (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
    )


def estimates(docs: DataFrame, rules: dict[str, str], sample_rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """Share of rejected rows and seconds of each rule on a sample of the rows that pass the base."""
    total = docs.count()
    if not total:
        return {name: (0.0, 1.0) for name in rules}
    drawn = docs.sample(min(1.0, sample_rows / total), seed=11).limit(2 * sample_rows).coalesce(1)
    sample = stored(measured(drawn), "rule_sample").filter(~F.col("base_failed")).coalesce(1)

    def seconds(rule: Column) -> tuple[float, float]:
        tries = []
        for _ in range(TRIALS):
            began = time.perf_counter()
            share = sample.agg(F.avg(rule.cast("double"))).first()[0]
            tries.append(time.perf_counter() - began)
        return share or 0.0, min(tries)

    _, least = seconds(F.lit(False))
    found = {name: seconds(F.expr(rule)) for name, rule in rules.items()}
    return {name: (share, max(cost - least, 1e-3)) for name, (share, cost) in found.items()}


def ordered(found: dict[str, tuple[float, float]]) -> list[str]:
    """Rules by rejection per cost, the best first; equal ones by cost, then by name."""
    return sorted(found, key=lambda name: (-found[name][0] / found[name][1], found[name][1], name))


def cascade(failed: Column, rules: list[str]) -> Column:
    """False where failed holds or else a rule does; rules behind the first one that holds are not evaluated."""
    verdict = F.when(failed, F.lit(False))
    for rule in rules:
        verdict = verdict.when(F.expr(rule), F.lit(False))
    return verdict.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """doc_id, the base measures, base_failed and kept for each row of docs (doc_id, text).

    The verdicts are stored: a caller's filter must not be pushed into the measures, where
    it would evaluate them again for every word.
    """
    rules = RULES if rules is None else rules
    order = ordered(estimates(docs, rules))
    rows = measured(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        cascade(F.col("base_failed"), [rules[name] for name in order]).alias("kept"),
    )
    return stored(rows, "verdicts")


SQL = r"""
with rows as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
     parts as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
                      list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines
               from rows),
     places as (select rid, words, unnest(range(0, len(words) - 2)) as i from parts),
     windows as (select rid, i, words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] as w from places),
     again as (select rid, w from windows group by rid, w having count(*) > 1),
     covered as (select distinct rid, unnest([i, i + 1, i + 2]) as p from windows join again using (rid, w)),
     repeats as (select rid, count(*) as n from covered group by rid),
     m as (select p.*, len(words) as n_words,
                  length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
                  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
                  len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words
           from parts p left join repeats using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words
            or 100 * n_symbols > 10 * n_words
            or word_chars < 2 * n_words or word_chars > 14 * n_words
            or 100 * n_dup_lines > 30 * len(lines)
            or 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 40 * word_chars
            or 100 * (length(text) - length(regexp_replace(text, '[!?]', '', 'g'))) > 30 * n_words
            or 100 * len(list_filter(range(1, n_words), lambda i: words[i] = words[i + 1])) > 20 * n_words
            or 100 * len(list_filter(words, lambda w: regexp_matches(w, '\p{L}'))) < 70 * n_words
            or 100 * len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 30 * len(lines)
            or 100 * len(list_filter(lines, lambda l: regexp_matches(l, '^[\x20\x09-\x0D]*[-*•]'))) > 90 * len(lines)
           ) as kept
from m"""
