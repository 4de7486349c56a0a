"""Secret scans in DataFrame expressions only.

Fixed patterns find assigned, access-key and hexadecimal secrets; further tokens are compared by
two first-order character Markov models, one of random strings and one of ordinary identifiers,
both counted from labelled samples. A token whose log-likelihood ratio is high enough for its length
(by held-out samples of both kinds) is a span of kind ``markov``. Spans are counted in code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.store import cut

# The base patterns, in the order in which ties are listed.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"

# Words that identifiers, paths and addresses are made of, beside those of the documents.
COMMON = "get set user users profile by id name abstract factory bean usr local lib python index news html http https www com org net service manager handler request response config default value file path data list item items count type class object create update delete find load save read write open close start stop init main test build source target client server session cache queue event error message status result version release system process thread buffer string number integer boolean array map key table column row query select insert order group page view model controller template image video audio document report account customer product price total amount date time year month day hour minute second first last next previous current parent child node tree graph edge color width height size length max min left right top bottom north south home var etc opt bin share include static assets media images scripts styles package module import export global local private public protected interface component application project archive"
SHAPES = 20
LONGEST = 64  # tokens from this length on have one threshold

_SPANS = "array<struct<s:int,k:int,e:int>>"
_PAIRS = "zip_with({0}, slice({0}, 2, greatest(size({0}) - 1, 0)), (a, b) -> ascii(a) * 128 + ascii(b))"


def _chars(token: str) -> str:
    return f"split({token}, '')"


def _spans(kind: int, pieces: str, found: str, keep: str) -> str:
    """Spans of the matches in found, between the pieces that split() leaves; keep is a condition on one match m."""
    step = f"named_struct('at', acc.at + length(x.p) + coalesce(length(x.m), 0), 'out', CASE WHEN x.m IS NOT NULL AND ({keep}) THEN concat(acc.out, array(named_struct('s', acc.at + length(x.p), 'k', {kind}, 'e', acc.at + length(x.p) + length(x.m)))) ELSE acc.out END)"
    return f"CASE WHEN size({found}) = 0 THEN cast(array() as {_SPANS}) ELSE aggregate({pieces}, named_struct('at', 0, 'out', cast(array() as {_SPANS})), (acc, x) -> {step}, acc -> acc.out) END"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def markov_model(samples: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Labelled samples (token string, random boolean) -> one row (llr array<double>) for pairs of ASCII characters.

    Entry a * 128 + b (from 0) is ln p(b | a, random) - ln p(b | a, ordinary), smoothed by alpha. Null
    tokens and pairs with other characters don't count; without samples every entry is 0.
    """
    pairs = samples.where("token is not null").select("random", F.expr(_chars("token")).alias("c")).select("random", F.explode(F.expr(_PAIRS.format("c"))).alias("pair"))
    n = pairs.where("pair between 0 and 16383").groupBy("pair").agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("i"))
    every = samples.sparkSession.range(128 * 128).select(F.col("id").cast("int").alias("pair")).join(n, "pair", "left").na.fill(0, ["r", "i"])
    of_first = every.groupBy(F.expr("pair div 128").alias("first")).agg(F.sum("r").alias("nr"), F.sum("i").alias("ni"))
    p = lambda k: F.log((F.col(k) + alpha) / (F.col(f"n{k}") + 128 * alpha))
    llr = every.join(of_first, F.expr("pair div 128") == F.col("first")).select("pair", (p("r") - p("i")).alias("x"))
    return llr.agg(F.expr("transform(array_sort(collect_list(struct(pair, x))), y -> y.x)").alias("llr"))


def _held() -> Column:
    """Whether a sample is for the thresholds, not for counts."""
    return F.crc32(F.col("token").cast("binary")) % 5 == 0


def thresholds(samples: DataFrame, model: DataFrame, least: float = 12.0) -> DataFrame:
    """Labelled samples and a model -> one row (llr, least array<double>): the least ratio of a span by token length, from 0.

    For each length from 16 on (up to LONGEST, in steps of 4) it lies halfway between the ratio that
    one in a thousand ordinary samples exceeds and the one that one in a hundred random samples falls
    short of, and never under the former or ``least``; lengths without samples of both kinds take the
    next shorter one's, or ``least``.
    """
    scored = samples.where("length(token) >= 16").withColumn("__llr", model.select("llr").scalar())
    scored = scored.select("random", F.expr(f"least(length(token), {LONGEST}) div 4").alias("b"), F.expr(f"aggregate({_PAIRS.format(_chars('token'))}, 0D, (s, i) -> s + coalesce(try_element_at(__llr, i + 1), 0D))").alias("x"))
    ends = scored.groupBy("b").agg(F.expr("percentile_approx(x, 0.999, 10000) FILTER (WHERE NOT random)").alias("o"), F.expr("percentile_approx(x, 0.01, 10000) FILTER (WHERE random)").alias("r"))
    cuts = ends.where("o is not null and r is not null").select("b", F.expr(f"greatest(o, (o + r) / 2, {least}D)").alias("x"))
    table = cuts.agg(F.expr("map_from_entries(collect_list(struct(b, x)))").alias("m"))
    by_length = f"transform(sequence(0, {LONGEST}), n -> coalesce(element_at(filter(transform(sequence(n div 4, 0, -1), k -> m[k]), y -> y is not null), 1), {least}D))"
    return table.crossJoin(model.select("llr")).select("llr", F.expr(by_length.replace("element_at(", "try_element_at(")).alias("least"))


def find_spans(docs: DataFrame, model: DataFrame, text_col: str = "text", least: float = 12.0) -> DataFrame:
    """docs with the column ``secret_spans`` array<struct<s, k, e>>: start, index in KINDS, end; by start, then kind.

    A null text counts as empty and has no spans. A token is a markov span if it has a letter, if
    its ratio is ``least`` or more (by its length, if the model has such a column), and if it isn't wholly inside a base span. Existing columns stay, except one
    that is named secret_spans in any case; their names clash with nothing. Rows stay as they are,
    repeated ones too; texts are scanned whole; an empty table gives no rows.
    """
    keep = [c for c in docs.columns if c.lower() != "secret_spans"]
    table = model.select("llr").scalar()
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.struct(*keep).alias("row"), text.alias("__t")).withColumns({"__a": F.expr(f"regexp_extract_all(__t, {_quoted(ASSIGN)}, 0)"), "__v": F.expr(f"regexp_extract_all(__t, {_quoted(ASSIGN)}, 2)"), "__k": F.expr(f"regexp_extract_all(__t, '{ACCESS}', 0)"), "__h": F.expr(f"regexp_extract_all(__t, '{HEX}', 0)"), "__m": F.expr(f"regexp_extract_all(__t, '{TOKEN}', 0)")})
    def named(pattern: str, m: str, more: str = "") -> str:
        extra = f", {more}" if more else ""
        fields = f"'p', z.`0`, 'm', z.`{m}`" + (f", 'v', z.`{more}`" if more else "")
        return f"transform(arrays_zip(split(__t, {_quoted(pattern)}, -1), {m}{extra}), z -> named_struct({fields}))"

    ratio = F.expr(f"transform(__m, t -> {_PAIRS.format(_chars('t'))})")
    found = found.withColumn("__pairs", ratio).withColumn("__llr", table)
    score = "transform(__pairs, q -> aggregate(q, 0D, (s, i) -> s + coalesce(try_element_at(__llr, i + 1), 0D)))"
    found = found.withColumn("__score", F.expr(f"CASE WHEN size(__m) = 0 THEN cast(array() as array<double>) ELSE {score} END"))
    base = [_spans(0, named(ASSIGN, "__a", "__v"), "__a", "length(x.v) >= 8"), _spans(1, named(ACCESS, "__k"), "__k", "true"), _spans(2, named(HEX, "__h"), "__h", "true")]
    found = found.withColumn("__base", F.expr(f"concat({', '.join(base)})"))
    if "least" in model.columns:
        found = found.withColumn("__least", model.select("least").scalar())
        enough = f"__least[least(length(x.m), {LONGEST})]"
    else:
        enough = f"{least}"
    more = _spans(3, named(TOKEN, "__m", "__score"), "__m", f"x.v >= {enough} AND x.m rlike '[A-Za-z]'")
    found = found.withColumn("__more", F.expr(f"CASE WHEN exists(__score, y -> y >= {least}) THEN {more} ELSE cast(array() as {_SPANS}) END"))
    free = "filter(__more, y -> NOT exists(__base, b -> b.s <= y.s AND y.e <= b.e))"
    return found.select("row.*", F.expr(f"array_sort(concat(__base, {free}))").alias("secret_spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, of a spans column."""
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    one = lambda x: F.concat(F.element_at(F.expr(kinds), x["k"] + 1), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 20_000, made: int = 3_000) -> DataFrame:
    """(token, random) from at most ``sample_docs`` documents, those whose ids hash lowest, and ``made`` generated strings.

    Random: values that the base patterns find, and encodings of hashes of 0 .. made - 1. Ordinary:
    distinct words of letters outside of what the base patterns find, and identifiers of SHAPES shapes (camel case, constants, snake case
    with numbers, paths, dates, versions, addresses) of two and three of them or of COMMON. The
    bound keeps the fit small; scanning has none.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).alias("__id")).where("__id is not null").distinct().orderBy(F.xxhash64("__id"), "__id").limit(sample_docs)
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(ids), "__id", "left_semi")
    values = F.expr(f"concat(filter(regexp_extract_all(t, {_quoted(ASSIGN)}, 2), v -> length(v) >= 8), regexp_extract_all(t, '{ACCESS}', 0), regexp_extract_all(t, '{HEX}', 0))")
    found = texts.select(F.explode(values).alias("token")).distinct().select("token", F.lit(True).alias("random"))
    digest = "unhex(sha2(cast(id as string), 256))"
    strings = spark.range(made).select(F.explode(F.expr(f"array(substr(base64({digest}), 1, 20 + id % 20), lower(hex(substr({digest}, 1, 16))), translate(upper(substr(base64({digest}), 1, 20)), '+/', 'QZ'))")).alias("token"), F.lit(True).alias("random"))
    free = texts.select(F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), HEX, " ").alias("t"))  # without what the base patterns find
    words = free.select(F.explode(F.expr("regexp_extract_all(t, '[A-Za-z]{4,}', 0)")).alias("w")).distinct()
    bucket = words.groupBy(F.expr("pmod(xxhash64(w), 1024)").alias("k")).agg(F.array_sort(F.collect_list("w")).alias("ws"))
    trios = bucket.select(F.explode(F.expr("transform(ws, (w, i) -> struct(w as a, ws[(i * 7 + 3) % size(ws)] as b, ws[(i * 11 + 5) % size(ws)] as c))")).alias("x")).select("x.*")
    common = F.array(*map(F.lit, sorted(set(COMMON.split()))))
    pick = lambda k: F.expr(f"__c[pmod(xxhash64(id, {k}), size(__c))]")
    made_up = spark.range(20_000).withColumn("__c", common).select(pick(1).alias("a"), pick(2).alias("b"), pick(3).alias("c"))
    h = "xxhash64(a, b, c)"
    n, day = f"pmod({h}, 1000)", f"date_format(date_add(date'1990-01-01', cast(pmod({h}, 18000) as int)), 'yyyy/MM/dd')"
    up = lambda x: f"initcap(lower({x}))"
    shapes = [
        "a", "concat_ws('_', lower(a), lower(b), lower(c))", "concat_ws('-', lower(a), lower(b), lower(c))", f"concat(lower(a), {up('b')}, {up('c')})", f"concat({up('a')}, {up('b')}, {up('c')})",
        f"concat(lower(a), {up('b')}, 'By', {up('c')}, {n} % 10)", "upper(concat(a, b, c))", "concat_ws('_', upper(a), upper(b), upper(c))", f"concat_ws('_', lower(a), lower(b), {n})", f"concat(lower(a), {n} % 100, '_', lower(b), {n} % 10)",
        "concat('/', concat_ws('/', lower(a), lower(b), lower(c)))", f"concat('/usr/', lower(a), '/', lower(b), {n} % 10, '/', lower(c))", f"concat('/', substr(lower(a), 1, 2), '/', lower(b), '/', {day}, '/', lower(c))", f"concat('//', lower(a), '/', lower(b), '/', {day})", f"concat(replace({day}, '/', '-'), 'T', lpad({n} % 24, 2, '0'), lpad({n} % 60, 2, '0'), '00Z-', lower(a))",
        f"concat(lower(a), '-', lower(b), '-', {n} % 10, '-', {n} % 37, '-', {n} % 11)", f"concat(lower(a), '-v', {n} % 20, '-', replace({day}, '/', ''))", f"concat({up('a')}, {up('b')}, {n})", "concat(lower(a), '=', lower(b), '/', lower(c))", f"concat('/', {up('a')}, '/', {up('b')}, '/', {up('c')}, {n} % 100)",
    ]
    every = f"array({', '.join(shapes)})"
    # a trio of the documents gives its word and three shapes, a trio of COMMON all of them
    of_docs = trios.select(F.explode(F.expr(f"array(a, {every}[1 + pmod({h}, {SHAPES - 1})], {every}[1 + pmod({h} + 5, {SHAPES - 1})], {every}[1 + pmod({h} + 11, {SHAPES - 1})])")).alias("token"))
    ordinary = of_docs.unionByName(made_up.select(F.explode(F.expr(every)).alias("token"))).where("length(token) >= 4").distinct()
    return found.unionByName(strings).unionByName(ordinary.select("token", F.lit(False).alias("random")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with ``secret_spans``, the models and thresholds trained from :func:`labelled_samples` of the same docs.

    Edge cases are those of :func:`find_spans`; without documents only the generated samples train.
    """
    samples = cut(labelled_samples(docs, id_col, text_col))
    model = cut(markov_model(samples.where(~_held())))
    return find_spans(docs, cut(thresholds(samples.where(_held()), model)), text_col)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs (with secret_spans) whose texts have each run of overlapping spans replaced by mark; a null text stays null.

    Rows and other columns stay; equal texts are redacted alike; an empty table gives no rows.
    """
    step = f"named_struct('at', greatest(acc.at, x.e), 'out', CASE WHEN x.s >= acc.at THEN concat(acc.out, array(substr(__t, acc.at + 1, x.s - acc.at), '{mark}')) ELSE acc.out END)"
    clean = "concat(array_join(__r.out, ''), substr(__t, __r.at + 1))"
    r = F.expr(f"aggregate(secret_spans, named_struct('at', 0, 'out', cast(array() as array<string>)), (acc, x) -> {step})")
    kept = [c for c in docs.columns if c.lower() != "secret_spans"]
    out = docs.select(F.struct(*kept).alias("row"), "secret_spans", F.col(text_col).alias("__t")).withColumn("__r", r)
    value = F.expr(f"CASE WHEN size(secret_spans) = 0 THEN __t ELSE {clean} END")
    return out.select(*[(value if c == text_col else F.col("row")[c]).alias(c) for c in kept])
