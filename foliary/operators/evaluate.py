"""Quality of answers against their question and context, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliary.functions.text import WORDS

# Question words that say nothing of the matter asked for.
ASKING = "what how why when where which who is are the a an in on for to of quoi comment pourquoi quand où quel quelle est sont le la les un une des de du".split()
# Phrases of an unsure answer.
UNSURE = ("i don't have", "i cannot", "no information", "je ne sais pas", "pas d'information")
# Words left out when an answer is compared with its context.
GROUNDING_STOPWORDS = (
    "le la les un une des de du et ou mais donc car ni que qui quoi dont où ce cette ces son sa ses leur leurs mon ma mes ton ta tes notre nos votre vos il elle ils "
    "elles je tu nous vous on se en y ne pas plus moins très bien peu trop aussi ainsi alors après avant avec sans sous sur dans pour par vers chez entre être avoir "
    "faire dire aller voir pouvoir vouloir devoir falloir est sont était sera serait peut doit fait dit va ont avait aura aurait the a an and or but if then else when "
    "at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "where why how all each few more most other some such no nor not only own same so than too very can will just should now is are was were be been being have has had "
    "having do does did doing would could might must shall may this that these those i you he she it we they what which who whom doivent peuvent selon conformément "
    "applicable requis exigé nécessaire approprié adéquat suivant"
).split()
NUMERIC = r"([0-9]+(?:[.,][0-9]+)?)\s*([\p{L}_][\p{L}\p{N}_]*)"
# Units that make a number a claim.
UNITS = r"^(heures?|hours?|h|minutes?|min|secondes?|seconds?|s|jours?|days?|mois|months?|ans?|years?|kg|kilogrammes?|kilograms?|lb|lbs|livres?|pounds?|km|kilomètres?|kilometers?|nm|m|mètres?|meters?|ft|feet|pieds?|kts?|knots?|noeuds?|mph|percent|degrés?|degrees?)$"
CLAIM = r"(?:CS|AMC[0-9]?|GM[0-9]?)(?:-[A-Z]+)? [0-9]+\.[0-9]+"
# The weights of the overall score.
WEIGHTS = {"faithfulness": 0.25, "answer_relevance": 0.25, "context_precision": 0.15, "context_utilization": 0.15, "reference_accuracy": 0.10, "completeness": 0.10}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _words(x: Column, pattern: str) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(x), F.lit(WORDS), 0), lambda w: w.rlike(pattern))


def _share(found: Column, of: Column) -> Column:
    return F.when(F.size(of) > 0, F.size(found) / F.size(of)).otherwise(0.0)


def _given(*cols: Column) -> Column:
    ok = F.lit(True)
    for c in cols:
        ok = ok & (F.coalesce(c, F.lit("")) != "")
    return ok


def faithfulness(answer: Column | str, context: Column | str) -> Column:
    """Share of sentences over 20 characters of which more than half the words (four letters or more) occur in the context."""
    a, c = _c(answer), _c(context)
    low = F.lower(c)
    sentences = F.filter(F.transform(F.split(a, r"[.!?]\s+"), lambda s: F.trim(s)), lambda s: F.length(s) > 20)

    def held(s):
        ws = _words(s, r"^[a-z]{4,}$")
        return (F.size(ws) > 0) & (F.size(F.filter(ws, lambda w: F.contains(low, w))) / F.size(ws) > 0.5)

    return F.when(~_given(a, c), 0.0).when(F.size(sentences) == 0, 0.5).otherwise(_share(F.filter(sentences, held), sentences))


def answer_relevance(question: Column | str, answer: Column | str) -> Column:
    """Share of the question's keywords in the answer, less for short, long and unsure answers."""
    q, a = _c(question), _c(answer)
    low = F.lower(a)
    keys = F.filter(F.array_distinct(_words(q, r"^[a-z]{3,}$")), lambda w: ~w.isin(ASKING))
    unsure = F.lit(False)
    for u in UNSURE:
        unsure = unsure | F.contains(low, F.lit(u))
    score = _share(F.filter(keys, lambda w: F.contains(low, w)), keys) * F.when(F.length(a) < 50, 0.5).when(F.length(a) > 2000, 0.8).otherwise(1.0) - F.when(unsure, 0.3).otherwise(0.0)
    return F.when(~_given(q, a), 0.0).when(F.size(keys) == 0, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def context_precision(question: Column | str, texts: Column) -> Column:
    """Share of source texts that hold over 30 per cent of the question's words (four letters or more)."""
    q = _c(question)
    keys = F.array_distinct(_words(q, r"^[a-z]{4,}$"))
    good = F.filter(texts, lambda t: F.size(F.filter(keys, lambda w: F.contains(F.lower(F.coalesce(t, F.lit(""))), w))) / F.size(keys) > 0.3)
    return F.when(~_given(q) | (F.size(texts) <= 0), 0.0).when(F.size(keys) == 0, 0.5).otherwise(F.size(good) / F.size(texts))


def context_utilization(answer: Column | str, context: Column | str) -> Column:
    """Share (doubled, at most 1) of the first 50 context sentences two of whose first five long words occur in the answer."""
    a, c = _c(answer), _c(context)
    low = F.lower(a)
    sentences = F.slice(F.filter(F.transform(F.split(c, r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: F.length(s) > 30), 1, 50)

    def used(s):
        ws = _words(s, r"^[a-z]{5,}$")
        return (F.size(ws) >= 3) & (F.size(F.filter(F.slice(ws, 1, 5), lambda w: F.contains(low, w))) >= 2)

    return F.when(~_given(a, c), 0.0).when(F.size(sentences) == 0, 0.5).otherwise(F.least(F.lit(1.0), F.size(F.filter(sentences, used)) / F.size(sentences) * 2))


def source_coverage(files: Column) -> Column:
    n = F.size(F.array_distinct(F.filter(files, lambda f: F.coalesce(f, F.lit("")) != "")))
    return F.when(F.size(files) <= 0, 0.0).when(n >= 5, 1.0).when(n >= 3, 0.8).when(n >= 2, 0.6).when(n == 1, 0.4).otherwise(0.2)


def reference_accuracy(answer: Column | str, context: Column | str) -> Column:
    """Share of the answer's references (upper case, spaces made hyphens) that stand so in the context; 1 without references.

    References with a space are never found in a context that keeps its spaces; this is what the measure has always done."""
    a, c = _c(answer), F.upper(F.coalesce(_c(context), F.lit("")))
    refs = F.array_distinct(F.transform(F.regexp_extract_all(a, F.lit(r"(?i)(?:CS|AMC|GM)[\s-]?[0-9]+(?:\.[0-9]+)*"), 0), lambda r: F.replace(F.upper(r), F.lit(" "), F.lit("-"))))
    return F.when(~_given(a), 0.5).when(F.size(refs) == 0, 1.0).otherwise(F.size(F.filter(refs, lambda r: F.contains(c, r))) / F.size(refs))


def completeness(answer: Column | str) -> Column:
    a = _c(answer)
    n = F.length(a)
    base = F.when(n > 500, 1.0).when(n > 200, 0.8).when(n > 100, 0.6).otherwise(0.4)
    bonus = F.when(a.rlike(r"[-•*]\s|[0-9]+[.)]\s|:\n"), 0.1).otherwise(0.0) + F.when(a.rlike(r"(?i)CS[\s-]?[0-9]+|AMC[\s-]?[0-9]+"), 0.1).otherwise(0.0)
    return F.when(~_given(a), 0.0).when(n < 50, 0.3).otherwise(F.least(F.lit(1.0), base + bonus))


def metrics(pairs: DataFrame, question: str = "question", answer: str = "answer", context: str = "context", texts: str = "texts", files: str = "files") -> DataFrame:
    """Adds the seven scores and their weighted overall (three places)."""
    out = pairs.withColumns(
        {
            "faithfulness": F.round(faithfulness(answer, context), 6),
            "answer_relevance": F.round(answer_relevance(question, answer), 6),
            "context_precision": F.round(context_precision(question, F.col(texts)), 6),
            "context_utilization": F.round(context_utilization(answer, context), 6),
            "source_coverage": source_coverage(F.col(files)),
            "reference_accuracy": F.round(reference_accuracy(answer, context), 6),
            "completeness": F.round(completeness(answer), 6),
        }
    )
    total = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return out.withColumn("overall", F.round(total, 3))


def summary(rows: DataFrame, order: str, last: int | None = None) -> DataFrame:
    """count and averages (three places) of the last rows by `order`."""
    if last is not None:
        rows = rows.orderBy(F.desc(order)).limit(last)
    return rows.agg(F.count("*").alias("n"), *[F.round(F.avg(k), 3).alias(f"mean_{k}") for k in (*WEIGHTS, "overall")])


def grounding_tokens(text: Column | str) -> Column:
    low = F.translate(F.lower(_c(text)), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "")
    return F.filter(F.split(low, r"[ \t\r\n\f]+"), lambda w: (F.length(w) > 2) & ~w.isin(GROUNDING_STOPWORDS))


def numeric_claims(text: Column | str) -> Column:
    """Numbers with a unit, as 'value unit'."""
    t = _c(text)
    both = F.arrays_zip(F.regexp_extract_all(t, F.lit(NUMERIC), 1).alias("v"), F.regexp_extract_all(t, F.lit(NUMERIC), 2).alias("u"))
    return F.transform(F.filter(both, lambda z: F.lower(z["u"]).rlike(UNITS)), lambda z: F.concat_ws(" ", z["v"], z["u"]))


def reference_claims(text: Column | str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(CLAIM), 0)


def claim_held(claim: Column, context: Column) -> Column:
    """The claim, or any of its numbers with either decimal mark, occurs in the context (lower case)."""
    numbers = F.regexp_extract_all(claim, F.lit(r"[0-9]+(?:[.,][0-9]+)?"), 0)
    return F.contains(context, F.lower(claim)) | F.exists(numbers, lambda n: F.contains(context, n) | F.contains(context, F.replace(n, F.lit("."), F.lit(","))) | F.contains(context, F.replace(n, F.lit(","), F.lit("."))))


def grounding_sentences(pairs: DataFrame, id_col: str, answer: str, context: str, least: float = 0.3) -> DataFrame:
    """id, pos, sentence, score, grounded: each sentence over 20 characters; its words and claims looked up in the context."""
    c = F.lower(F.coalesce(F.col(context), F.lit("")))
    # a sentence ends with its mark before white space and a capital
    parts = F.split(F.col(answer), r"(?<=[.!?])\s+(?=[A-Z])")
    rows = pairs.select(F.col(id_col).alias("id"), F.array_distinct(grounding_tokens(c)).alias("held"), c.alias("context"), F.posexplode(F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) > 20)).alias("pos", "sentence"))
    tokens = grounding_tokens("sentence")
    rows = rows.withColumn("tokens", tokens).withColumn("claims", F.concat(numeric_claims("sentence"), reference_claims("sentence")))
    overlap = F.when(F.size("tokens") == 0, 1.0).otherwise(F.size(F.filter("tokens", lambda w: F.array_contains("held", w))) / F.size("tokens"))
    verified = F.size(F.filter("claims", lambda x: claim_held(x, F.col("context"))))
    score = F.when(F.size("claims") > 0, 0.4 * overlap + 0.6 * verified / F.size("claims")).otherwise(overlap)
    rows = rows.withColumn("score", F.round(score, 6)).withColumn("n_claims", F.size("claims")).withColumn("n_verified", verified)
    return rows.select("id", "pos", "sentence", "n_claims", "n_verified", "score", (F.col("score") >= least).alias("grounded"))


def grounding_report(sentences: DataFrame) -> DataFrame:
    """id, sentences, grounded, score (mean), risk: low from 0.7, medium from 0.4, else high."""
    out = sentences.groupBy("id").agg(F.count("*").alias("sentences"), F.sum(F.col("grounded").cast("int")).alias("grounded"), F.round(F.avg("score"), 6).alias("score"))
    return out.withColumn("risk", F.when(F.col("score") >= 0.7, "low").when(F.col("score") >= 0.4, "medium").otherwise("high"))


def evidence(pairs: DataFrame, id_col: str, answer: str, context: str, least: float = 0.3, most: int = 3) -> DataFrame:
    """id, pos, evidence_pos: for each answer sentence the first context sentences that share enough of its distinct tokens."""

    def split(c):
        return F.filter(F.transform(F.split(F.col(c), r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: F.trim(s)), lambda s: F.length(s) > 20)

    a = pairs.select(F.col(id_col).alias("id"), F.posexplode(split(answer)).alias("pos", "s"), split(context).alias("c"))
    b = a.select("id", "pos", F.array_distinct(grounding_tokens("s")).alias("t"), F.posexplode("c").alias("evidence_pos", "e"))
    share = F.size(F.array_intersect("t", F.array_distinct(grounding_tokens("e")))) / F.size("t")
    w = Window.partitionBy("id", "pos").orderBy("evidence_pos")
    return b.where(F.size("t") > 0).where(share >= least).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("id", "pos", "evidence_pos")


def store_metrics(new: DataFrame, path: str) -> None:
    """Append rows of metrics to the store at a path, with the order of their insertion (seq) after what is there."""
    spark = new.sparkSession
    held = load_metrics(spark, path)
    last = held.agg(F.max("seq")).first()[0] if held is not None else None
    placed = new.withColumn("seq", F.monotonically_increasing_id() + F.lit(0 if last is None else last + 1))
    placed.write.mode("append").parquet(path)


def load_metrics(spark: SparkSession, path: str) -> DataFrame | None:
    """The store at a path, or None where there is none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.parquet(path) if there else None


def store_summary(stored: DataFrame, names: list[str], last: int | None = None) -> DataFrame:
    """n, the means of the named scores (three places), first and last timestamp by insertion; of the last rows only, if asked."""
    rows = stored if last is None else stored.orderBy(F.desc("seq")).limit(last)
    return rows.agg(F.count("*").alias("n"), *[F.round(F.avg(k), 3).alias(f"mean_{k}") for k in names], F.min_by("timestamp", "seq").alias("first"), F.max_by("timestamp", "seq").alias("last"))
