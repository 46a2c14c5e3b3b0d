"""What a question wants: intent, domain, complexity, entities, and what follows for the search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of each intent, in the order that decides ties. They are applied to the lower-cased question between spaces,
# so that a space or sign stands for a word's edge.
INTENTS = {
    "definition": (r"qu['’]?est[- ]ce que?", r"défini(?:r|tion|ssez)", r"signifie", r"what is", r"define", r"meaning of", r"c['’]est quoi", r"explique[rz]?\s+(?:le concept|la notion)"),
    "procedure": (r"comment\s+(?:faire|procéder|effectuer|réaliser)", r"étapes?\s+(?:pour|de|à suivre)", r"procédure\s+(?:pour|de)", r"how to", r"steps to", r"process for", r"méthode\s+pour", r"manière\s+de"),
    "requirement": (r"exigences?\s+(?:pour|de|relatives?)", r"conditions?\s+(?:pour|de|requises?)", r"prérequis", r"requirements?\s+(?:for|to)", r"nécessaires?\s+pour", r"qu['’]?(?:est[- ]ce qui est|faut[- ]il)\s+(?:requis|exigé|nécessaire)", r"obligatoire", r"doit[- ]on", r"faut[- ]il"),
    "comparison": (r"différence\s+entre", r"comparer?", r"versus", r"vs\.?", r"distinguer?", r"difference between", r"compare", r"par rapport à", r"contrairement à"),
    "reference": (r"où\s+(?:trouver|est[- ]ce|se trouve)", r"quel\s+(?:texte|règlement|article|paragraphe)", r"référence\s+(?:du|de la|réglementaire)", r"source", r"where\s+(?:to find|is|can)", r"which\s+(?:regulation|rule|document)", r"quelle?\s+(?:partie|part|annexe|annex)"),
    "factual": (r"combien", r"quelle?\s+(?:durée|nombre|quantité|valeur)", r"à partir de\s+(?:quel|combien)", r"how (?:many|much|long)", r"minimum", r"maximum", r"limite", r"durée\s+(?:de validité|minimale|maximale)", r"[0-9]+\s*(?:heures?|h|ans?|mois|jours?)"),
    "eligibility": (r"qui peut", r"éligible", r"pour être", r"conditions?\s+(?:d['’]accès|pour accéder)", r"who can", r"eligib(?:le|ility)", r"permis\s+de", r"autor[iu]s[ée]\s+à"),
    "troubleshoot": (r"que\s+faire\s+(?:si|en cas)", r"en\s+cas\s+de", r"si\s+(?:je|on|l['’]on)", r"what\s+(?:to do|if)", r"problème", r"incident", r"panne", r"échoue"),
    "list": (r"list(?:er?|e[zs]?)", r"énumérer?", r"quels?\s+sont", r"quelles?\s+sont", r"tous\s+les", r"toutes\s+les", r"list\s+(?:of|all|the)", r"what are"),
}
# Patterns of each domain, in the order that decides ties.
DOMAINS = {
    "licensing": r"fcl licence license pilote pilot qualification rating type\s+rating atpl cpl ppl lapl ir instructeur instructor examinateur examiner check test examen exam".split(" "),
    "operations": r"ops opérations? operations? cat ncc nco spo vol flight mission frm fatigue ftl fdm minima meteo météo".split(" "),
    "airworthiness": (r"part[- ]?21", r"part[- ]?m", r"part[- ]?145", "maintenance", "navigabilité", "airworthiness", "cen", "arc", r"certificat\s+de\s+type", "modification", "stc", "ad", "airworthiness directive"),
    "medical": ("médical", "medical", r"classe\s+[12]", r"class\s+[12]", "ame", r"aero[-\s]?medical", r"lapl\s+medical", "aptitude", "fitness", "incapacit[ée]"),
    "training": "ato formation training entraînement simulateur simulator fstd ffs cours course module programme".split(),
    "safety": "sms sécurité safety occurrence incident accident risque risk hazard enquête investigation".split(),
}
# Patterns of complexity, the harder first.
COMPLEXITY = {
    "complex": (r"et\s+aussi", r"ainsi\s+que", r"en\s+tenant\s+compte", r"plusieurs?", r"tou(?:s|tes)\s+les", r"comparer?", r"différence", r"en\s+détail", r"exhaustive?ment"),
    "moderate": ("pourquoi", r"expliquer?", "décrire", "comment", r"quelles?\s+sont"),
}
# Fixed values: (dense, lexical) weights by intent.
WEIGHTS = {
    "definition": (0.5, 0.5), "procedure": (0.75, 0.25), "requirement": (0.55, 0.45), "comparison": (0.7, 0.3), "reference": (0.4, 0.6),
    "factual": (0.45, 0.55), "list": (0.55, 0.45), "eligibility": (0.65, 0.35), "troubleshoot": (0.7, 0.3), "general": (0.6, 0.4),
}
# How many times as many sources an intent asks for.
MULTIPLIERS = {"procedure": 1.5, "comparison": 2.0, "list": 2.0}
# Sections that an intent looks for; intents for exact matches, for rewording, and for recent sources.
SECTIONS = {
    "definition": ["définition", "definition", "glossaire", "glossary"], "procedure": ["procédure", "procedure", "méthode", "method"],
    "requirement": ["exigences", "requirements", "conditions"], "reference": ["référence", "reference", "applicable"],
}
EXACT, REWORDED, RECENT = ("definition", "requirement", "reference", "factual"), ("comparison",), ("factual",)
ENTITY = (
    r"(?:EASA\s*)?Part[- ]?[0-9]+|FCL[.\-]?[0-9]+(?:\.[A-Z]\.[0-9]+)?|(?:FAR|FAA)\s*[0-9]+[.-][0-9]+|CS(?:-[A-Z]+)?\s*[0-9]+[A-Z]?(?:[.\-][0-9]+[A-Za-z]?)?|"
    r"AMC[0-9]{0,2}(?:-[A-Z]+)?\s*[0-9]+[A-Z]?(?:[.\-][0-9]+[A-Za-z]?)?|GM[0-9]{0,2}(?:-[A-Z]+)?\s*[0-9]+[A-Z]?(?:[.\-][0-9]+[A-Za-z]?)?|(?:CAT|ORO|SPA|NCO|NCC|SPO)\.[A-Z]+(?:\.[A-Z]+)*\.[0-9]+"
)


def edged(pattern: str) -> str:
    """A pattern between characters that are no letters, digits or underscores (or the text's ends)."""
    return rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{pattern})(?:$|[^\p{{L}}\p{{N}}_])"


def _hits(question: Column, patterns) -> Column:
    return sum((question.rlike(edged(p)).cast("int") for p in patterns), F.lit(0))


def normalised(question: str = "question") -> Column:
    """Spaces made one, ends trimmed, closing marks taken off."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.col(question), r"\s+", " ")), r"[?!.]+$", ""))


def _best(scores: dict[str, Column], none: str) -> Column:
    """The name with the highest positive score; ties go to the first."""
    top = F.greatest(*scores.values())
    out = F.lit(none)
    for name, s in reversed(scores.items()):
        out = F.when((s == top) & (top > 0), name).otherwise(out)
    return out


def analyse(questions: DataFrame, question: str = "question", base_top_k: int = 10) -> DataFrame:
    """Adds intent, intent_score, secondary_intents (the next two with a score), domain, complexity, entities, dense_weight, sparse_weight, top_k,
    and hints for the search: filter_sections, required_keywords, exact_match, reword, recent. A null question is general."""
    q = F.lower(F.coalesce(normalised(question), F.lit("")))
    intents = {k: F.round(F.least(F.lit(1.0), _hits(q, p) / max(1.0, 0.3 * len(p))), 6) for k, p in INTENTS.items()}
    domains = {k: _hits(q, p) for k, p in DOMAINS.items()}
    out = questions.withColumns({f"_i_{k}": v for k, v in intents.items()} | {f"_d_{k}": v for k, v in domains.items()})
    out = out.withColumn("intent", _best({k: F.col(f"_i_{k}") for k in INTENTS}, "general"))
    out = out.withColumn("intent_score", F.when(F.col("intent") == "general", 0.5).otherwise(F.greatest(*[F.col(f"_i_{k}") for k in INTENTS])))
    # names by falling score, ties in the order of the table; the first is the intent itself
    order = F.array_sort(F.array(*[F.struct((-F.col(f"_i_{k}")).alias("s"), F.lit(n).alias("n"), F.lit(k).alias("k")) for n, k in enumerate(INTENTS)]))
    out = out.withColumn("secondary_intents", F.transform(F.filter(F.slice(order, 2, 2), lambda x: x["s"] < 0), lambda x: x["k"]))
    out = out.withColumn("domain", _best({k: F.col(f"_d_{k}") for k in DOMAINS}, "general"))
    hard = _hits(q, COMPLEXITY["complex"]) > 0
    fair = (_hits(q, COMPLEXITY["moderate"]) > 0) | (F.size(F.filter(F.split(q, " "), lambda w: w != "")) > 20)
    out = out.withColumn("complexity", F.when(hard, "complex").when(fair, "moderate").otherwise("simple"))
    out = out.withColumn("entities", F.regexp_extract_all(F.coalesce(normalised(question), F.lit("")), F.lit(ENTITY), 0))
    dense, sparse, times = F.lit(WEIGHTS["general"][0]), F.lit(WEIGHTS["general"][1]), F.lit(1.0)
    for k, (d, s) in WEIGHTS.items():
        dense, sparse = F.when(F.col("intent") == k, d).otherwise(dense), F.when(F.col("intent") == k, s).otherwise(sparse)
    for k, m in MULTIPLIERS.items():
        times = F.when(F.col("intent") == k, m).otherwise(times)
    times = F.when(F.col("complexity") == "complex", F.greatest(times, F.lit(2.0))).otherwise(times)
    out = out.withColumns({"dense_weight": dense, "sparse_weight": sparse, "top_k": F.greatest(F.lit(3), F.floor(base_top_k * times).cast("int"))})
    wanted = F.array().cast("array<string>")
    for k, names in SECTIONS.items():
        wanted = F.when(F.col("intent") == k, F.array(*map(F.lit, names))).otherwise(wanted)
    is_one = lambda names: F.col("intent").isin(*names)
    out = out.withColumns({"filter_sections": wanted, "required_keywords": F.col("entities"), "exact_match": is_one(EXACT), "reword": is_one(REWORDED) | (F.col("complexity") == "complex"), "recent": is_one(RECENT)})
    return out.drop(*[f"_i_{k}" for k in INTENTS], *[f"_d_{k}" for k in DOMAINS])


def variants(questions: DataFrame, question: str = "question") -> DataFrame:
    """query_id, variant_no, variant: the question and up to four rewordings: the same section of the neighbouring document kinds, then the
    intent's own phrasing, then the domain's name. questions: query_id, question, intent, and domain if it is to count."""
    q = F.col(question)
    ref = F.regexp_extract(q, r"(CS|AMC|GM)[0-9]{0,2}\s+([0-9]+[A-Z]?(?:[.\-][0-9]+[A-Za-z]?)?)", 0)
    number = F.regexp_extract(q, r"(CS|AMC|GM)[0-9]{0,2}\s+([0-9]+[A-Z]?(?:[.\-][0-9]+[A-Za-z]?)?)", 2)
    base = F.regexp_extract(q, r"(CS|AMC|GM)[0-9]{0,2}\s+([0-9]+[A-Z]?(?:[.\-][0-9]+[A-Za-z]?)?)", 1)

    def other(a, b, c):
        kind = F.when(base == "CS", a).when(base == "AMC", b).otherwise(c)
        return F.when(ref != "", F.replace(q, ref, F.concat_ws(" ", kind, number)))

    lead = {"definition": ("définition ", "qu'est-ce que "), "requirement": ("exigences ", "conditions requises "), "procedure": ("procédure ", "étapes ")}

    def led(i):
        out = F.lit(None).cast("string")
        for k, v in lead.items():
            asked = F.col("intent") == k
            if k == "definition":
                asked = asked & ~F.contains(F.lower(q), F.lit("qu'est-ce que"))
            out = F.when(asked, F.concat(F.lit(v[i]), q)).otherwise(out)
        return out

    named = F.lit(None).cast("string")
    if "domain" in questions.columns:
        for domain, word in (("licensing", "FCL"), ("operations", "OPS")):
            named = F.when((F.col("domain") == domain) & ~F.contains(F.lower(q), F.lit(word.lower())), F.concat(F.lit(word + " "), q)).otherwise(named)
    all_ = F.slice(F.array_distinct(F.array_compact(F.array(q, other("AMC", "CS", "CS"), other("GM", "GM", "AMC"), led(0), led(1), named))), 1, 5)
    return questions.select("query_id", F.posexplode(all_).alias("variant_no", "variant"))
