"""Quality rules in DataFrame expressions only, as a short-circuit cascade.

Base measures are taken of every whole text. The rules of the method look at texts that pass the
base; their order comes from a sample, on which each rule's cost (characters and words looked at) and
selectivity (share rejected) are estimated: the rule that rejects most for its cost goes first, and a text that one
rule rejects is not looked at by the next. The verdict is the same in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.store import cut

SPACE = r"[\x20\x09-\x0D]"
# The rules, as conditions under which a text is rejected, and the characters and words that
# deciding one takes. Columns: __t the text, __w its words, and the base measures.
RULES = {
    "symbols": ("n_symbols * 10 > word_chars", "1"),
    "shouting": ("length(regexp_replace(__t, '[^!]+', '')) * 2 > n_words", "length(__t)"),
    "upper": ("n_words >= 20 AND length(regexp_replace(__t, r'\\P{Lu}+', '')) * 2 > word_chars", "CASE WHEN n_words >= 20 THEN 2 * length(__t) ELSE 1 END"),
    "repeated_lines": ("n_dup_lines * 10 > 3 * size(filter(split(__t, '\\n', -1), x -> x rlike r'[^\\x20\\x09-\\x0D]'))", "2 * length(__t)"),
    "wordless": ("size(filter(__w, x -> NOT x rlike r'\\p{L}')) * 2 > n_words", "word_chars + 10 * n_words"),
    "same_word": ("n_words >= 50 AND size(array_distinct(__w)) * 10 < n_words", "CASE WHEN n_words >= 50 THEN word_chars + 5 * n_words ELSE 1 END"),
    "long_words": ("n_words >= 20 AND word_chars > 25 * n_words", "1"),
}


def measures(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, __t, __w, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of every row.

    A null text has no words. Words that lie in a five-word window found twice are counted from the
    sorted hashes of all windows; texts without a repeated window skip the sort.
    """
    d = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    d = d.withColumn("__w", F.expr(f"filter(split(__t, r'{SPACE}+', -1), x -> x <> '')"))
    d = d.withColumn("__x", F.expr("transform(__w, x -> xxhash64(x))"))
    window = "xxhash64(__x[i], __x[i + 1], __x[i + 2], __x[i + 3], __x[i + 4])"
    d = d.withColumn("__g", F.expr(f"CASE WHEN size(__x) < 6 THEN cast(array() as array<bigint>) ELSE transform(sequence(0, size(__x) - 5), i -> {window}) END"))
    d = d.withColumn("__s", F.expr("CASE WHEN size(array_distinct(__g)) < size(__g) THEN sort_array(transform(__g, (h, i) -> struct(h as h, i as i))) ELSE cast(array() as array<struct<h:bigint,i:int>>) END"))
    # of the sorted windows: those with an equal neighbour, by position
    twice = "sort_array(transform(filter(zip_with(zip_with(__s, concat(array(cast(null as struct<h:bigint,i:int>)), slice(__s, 1, greatest(size(__s) - 1, 0))), (x, y) -> struct(x as x, y.h as p)), slice(__s, 2, greatest(size(__s) - 1, 0)), (z, n) -> struct(z.x.i as i, z.x.h as h, z.p as p, n.h as n)), q -> q.h <=> q.p OR q.h <=> q.n), q -> q.i))"
    d = d.withColumn("__r", F.expr(f"CASE WHEN size(__s) = 0 THEN cast(array() as array<int>) ELSE {twice} END"))
    covered = "aggregate(__r, named_struct('n', 0L, 'end', 0), (acc, i) -> named_struct('n', acc.n + i + 5 - greatest(i, acc.end), 'end', i + 5), acc -> acc.n)"
    lines = r"filter(split(__t, '\n', -1), x -> x rlike r'[^\x20\x09-\x0D]')"
    d = d.withColumn("__l", F.expr(lines))
    d = d.select(
        id_col, "__t", "__w",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
    )
    return d.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))


def cascade_order(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_rows: int = 1_000, rules: dict[str, tuple[str, str]] = RULES) -> list[str]:
    """Names of the rules by rejection per cost, estimated on at most ``sample_rows`` rows, those whose ids hash lowest.

    A rule's cost is the mean of its cost expression, its selectivity the share that it rejects of
    what the rules before it leave: the best comes first, and the others are rated anew on the rest. Rows with a
    null id are not sampled, null texts count as empty, of repeated ids the first rows up to the bound; an empty table gives the rules by name, the last first.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    ids = named.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = cut(measures(named.join(F.broadcast(ids), "doc_id", "left_semi").limit(sample_rows))).where("NOT base_failed")
    found = sample.select(*[F.struct(F.expr(rejects).alias("no"), F.expr(cost).cast("double").alias("cost")).alias(name) for name, (rejects, cost) in rules.items()])
    rows, left, order = [r.asDict() for r in found.collect()], list(rules), []
    while left:
        rate = lambda n: (sum(bool(r[n]["no"]) for r in rows) + 0.01) / max(1.0, sum(r[n]["cost"] for r in rows) / max(1, len(rows)))  # noqa: B023,E731
        best = max(left, key=lambda n: (rate(n), n))  # noqa: B023
        order.append(best)
        left.remove(best)
        rows = [r for r in rows if not r[best]["no"]]
    return order


def judge(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: dict[str, tuple[str, str]] = RULES, order: list[str] | None = None) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), a row for each row of docs.

    kept is false where the base fails or a rule rejects. A null or empty text has no words and fails
    the base; texts are measured whole; repeated rows and null ids are judged like any other. Other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    order = order if order is not None else cascade_order(docs, text_col, id_col, rules=rules)
    verdict = F.when(F.col("base_failed"), F.lit(False))
    for name in order:
        verdict = verdict.when(F.expr(rules[name][0]), F.lit(False))
    judged = measures(docs, text_col, id_col).withColumn("kept", verdict.otherwise(F.lit(True))).drop("__t", "__w")
    # a filter on these columns must not be pushed down into, and repeated in, their long expressions
    return judged.select(F.inline(F.array(F.struct(*judged.columns))))
