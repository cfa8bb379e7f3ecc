"""Secret scans: fixed patterns, and tokens that read like random strings. DataFrame functions only.

Two character Markov models, of random strings and of ordinary identifiers, are trained from labelled samples: pair counts
with add-one smoothing. A token whose log-likelihood ratio between the two is high is a secret.

The labelled samples are bounded: ``n_random`` strings in several alphabets cut from hashes of a counter, and as ordinary
ones ``IDENTIFIERS`` in the usual spellings and the words of about ``n_docs`` documents, drawn by a hash of their text and read
whole. The scan itself covers every character of every text.

Positions come from ``\\G(.*?)pattern``, which yields each match with the gap before it; running sums of both lengths over
a document's matches are its places in code points.

Defined cases: null text counts as empty; an empty table gives no rows (the model then knows ``IDENTIFIERS`` only);
repeated rows are scanned one by one; extra columns are kept by ``redact_secrets`` and ignored by ``scan_secrets``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessella.llm.common import materialize

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: The kinds in the order that breaks ties of the same start: pattern, what is measured (0: the match), least length.
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", False, 18),
    "hex": (r"[0-9a-f]{16,}", False, 16),
}
#: Candidates of the models.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
MIN_TOTAL, MIN_MEAN = 6.0, 0.5
#: What joins a token to a name or path, and the least length of a part.
JOINTS, PART = ("[/=_-]+", "=+"), 16
#: Ordinary parts of identifiers, from which the labelled identifiers are put together.
IDENTIFIERS = (
    "get set is has make build read write load store open close file path name value index count total user account order item list map array node tree graph "
    "table row column key hash token parse format print error warning message request response server client config option default handler manager service factory "
    "controller repository session context buffer stream thread process event listener callback update delete insert select create remove source target input output "
    "first last next previous current parent child left right start end begin finish time date year month day hour minute second size length width height"
).split()


def train_model(docs: DataFrame, n_random: int = 3000, n_docs: int = 1000) -> list[float]:
    """Log-likelihood ratio of every pair of characters, a row of ``ALPHABET`` after the other. Collects one number a pair."""
    spark = docs.sparkSession
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    base64 = F.base64(F.unhex(digest("b")))
    random = spark.range(n_random).select(F.explode(F.array(
        F.substring(digest("a"), 1, 40), F.upper(F.substring(digest("c"), 1, 40)), base64, F.translate(base64, "+/=", "AZq"),
        F.translate(F.upper(base64), "+/=", "K7Q"), F.translate(base64, "+/=", "-_"),
    )).alias("s"))
    part = lambda k: F.element_at(F.array(*[F.lit(w) for w in IDENTIFIERS]), (F.abs(F.xxhash64("id", F.lit(k))) % len(IDENTIFIERS) + 1).cast("int"))
    a, b, c = part(1), part(2), part(3)
    plain = spark.range(n_random).select(F.explode(F.array(
        F.concat_ws("_", a, b, c), F.concat(a, F.initcap(b), F.initcap(c)), F.concat_ws("-", a, b, c), F.upper(F.concat_ws("_", a, b)), F.concat_ws("/", a, b, c), F.concat(a, b, c),
        F.repeat(F.substr(F.lit("-=_/+"), (F.col("id") % 5 + 1).cast("int"), F.lit(1)), F.lit(20)),
    )).alias("s"))
    rate = min(1.0, n_docs / max(1, docs.count()))
    some = docs.where("text is not null").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < rate * (1 << 30)).select("text")
    words = some.select(F.explode_outer(F.regexp_extract_all("text", F.lit(r"[A-Za-z_/-]{2,15}"), F.lit(0))).alias("s")).where("s is not null")
    both = random.select("s", F.lit(1).alias("y")).unionByName(plain.unionByName(words).select("s", F.lit(0).alias("y")))
    both = both.where(F.length("s") > 1).select("y", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring("s", i, 2))).alias("pair"))
    n = len(ALPHABET)
    counts = [[[1.0] * n for _ in range(n)] for _ in range(2)]
    for r in both.groupBy("y", "pair").count().collect():  # two labels and n * n pairs at most
        counts[r["y"]][ALPHABET.index(r["pair"][0])][ALPHABET.index(r["pair"][1])] += r["count"]
    return [math.log(counts[1][i][j] / sum(counts[1][i])) - math.log(counts[0][i][j] / sum(counts[0][i])) for i in range(n) for j in range(n)]


def _llr(spark: SparkSession, model: list[float], token):
    """Sum over the pairs of ``token`` of the model's ratios. The split of a literal folds into one constant array."""
    ratios = F.split(F.lit(",".join(f"{x:.5f}" for x in model)), ",").cast("array<double>")
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, 1)) - 1
    return F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda s, i: s + F.get(ratios, at(i) * len(ALPHABET) + at(i + 1)))


def _matches(text, order: int, pattern: str, has_group: bool):
    """Array of (kind, i, gap, size, token) of all matches of ``pattern``; the pattern's own group is the last."""
    whole = rf"(?s)\G(.*?)({pattern})"
    take = lambda g: F.regexp_extract_all(text, F.lit(whole), F.lit(g))
    value = take(3) if has_group else take(2)
    zipped = F.arrays_zip(take(1).alias("g"), take(2).alias("m"), value.alias("v"))
    shape = f"array<struct<kind:int,i:int,gap:int,size:int,token:string>>"
    made = F.transform(zipped, lambda x, i: F.struct(F.lit(order).alias("kind"), i.alias("i"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"), x["v"].alias("token")))
    return F.when(F.rlike(text, F.lit(pattern)), made).otherwise(F.array()).cast(shape)


def scan_secrets(docs: DataFrame, model: list[float] | None = None, min_total: float = MIN_TOTAL, min_mean: float = MIN_MEAN) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id and ``spans``, sorted array of (start, order, kind, stop).

    Spans of the kind ``random`` are tokens of 16 or more characters that the models take for random, unless a span of a
    fixed pattern covers them. They need ``min_total`` nats altogether and ``min_mean`` a pair of characters.
    """
    model = train_model(docs) if model is None else model
    names = [*KINDS, "random"]
    df = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = [_matches(F.col("text"), k, KINDS[n][0], KINDS[n][1]) for k, n in enumerate(KINDS)] + [_matches(F.col("text"), len(KINDS), TOKEN, False)]
    mark = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit(0).alias("size"), F.lit("").alias("token")))
    rows = df.select("rid", "doc_id", F.explode_outer(F.concat(mark, *parts)).alias("m")).select("rid", "doc_id", "m.*")

    def like_random(token):
        llr = _llr(docs.sparkSession, model, token)
        return (llr >= min_total) & (llr >= min_mean * (F.length(token) - 1))

    pieces = F.concat(*[F.split("token", joint) for joint in JOINTS])
    inner = F.exists(F.filter(pieces, lambda p: (F.length(p) >= PART) & (p != F.col("token"))), like_random)
    random = F.when(F.col("kind") == len(KINDS), like_random(F.col("token")) | inner)
    least = F.element_at(F.array(*[F.lit(KINDS[n][2]) for n in KINDS]), F.greatest(F.col("kind"), F.lit(0)) + 1)
    good = F.when(F.col("kind") < 0, True).when(F.col("kind") < len(KINDS), F.length("token") >= least).otherwise(random)
    rows = rows.select("rid", "doc_id", "kind", "i", "gap", "size", good.alias("good"))
    rows = rows.repartition("rid")  # what follows needs the rows of a document together, and no more
    upto = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(upto)).where("good")
    span = F.when(F.col("kind") >= 0, F.struct((F.col("stop") - F.col("size")).alias("start"), F.col("kind").alias("order"), F.element_at(F.array(*[F.lit(n) for n in names]), F.greatest(F.col("kind"), F.lit(0)) + 1).alias("kind"), "stop"))
    out = rows.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("spans"))
    fixed = F.filter("spans", lambda s: s["order"] < len(KINDS))
    free = lambda s: (s["order"] < len(KINDS)) | ~F.exists("fixed", lambda f: (f["start"] <= s["start"]) & (f["stop"] >= s["stop"]))
    return out.withColumn("fixed", fixed).select("doc_id", F.filter("spans", free).alias("spans"))


def span_text(spans):
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact_secrets(docs: DataFrame, model: list[float] | None = None, mask: str = "<secret>", span_limit: int = 200_000) -> DataFrame:
    """``docs`` (doc_id, text, n_chars, ..) with every secret span replaced by ``mask`` and n_chars counted anew.

    All rows and columns stay. Rows are matched by doc_id and text, so that a repeated id takes the spans of its own text.
    """
    key = F.xxhash64("text")
    hashed = docs.withColumn("__key", key)
    spans = scan_secrets(docs.select(F.struct("doc_id", key.alias("k")).alias("doc_id"), "text"), train_model(docs) if model is None else model)
    found = materialize(spans.where(F.size("spans") > 0).select(F.col("doc_id.doc_id").alias("__id"), F.col("doc_id.k").alias("__k"), F.transform("spans", lambda s: F.struct(s["start"].alias("a"), s["stop"].alias("b"))).alias("__spans")).distinct(), "secrets")
    total = found.agg(F.coalesce(F.sum(F.size("__spans")), F.lit(0))).first()[0]
    found = F.broadcast(found) if total <= span_limit else found
    # overlapping spans become one
    merged = F.aggregate(
        "__spans", F.array().cast("array<struct<a:bigint,b:bigint>>"),
        lambda out, s: F.when((F.size(out) > 0) & (F.element_at(out, -1)["b"] >= s["a"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["a"].alias("a"), F.greatest(F.element_at(out, -1)["b"], s["b"]).cast("long").alias("b"))))).otherwise(F.concat(out, F.array(F.struct(s["a"].cast("long").alias("a"), s["b"].cast("long").alias("b"))))),
    )
    out = hashed.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k")), "left").withColumn("__m", F.when(F.col("__spans").isNotNull(), merged))
    piece = lambda s, i: F.substr(F.col("text"), F.when(i == 0, F.lit(0)).otherwise(F.element_at("__m", F.greatest(i, F.lit(1)))["b"]).cast("int") + 1, (s["a"] - F.when(i == 0, F.lit(0)).otherwise(F.element_at("__m", F.greatest(i, F.lit(1)))["b"])).cast("int"))
    tail = F.substr(F.col("text"), (F.element_at("__m", -1)["b"] + 1).cast("int"), F.length("text"))
    text = F.when(F.col("__m").isNotNull(), F.concat(F.array_join(F.transform("__m", piece), mask), F.lit(mask), tail)).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__m").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
