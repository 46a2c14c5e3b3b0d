"""Expressions on text: tokens, keywords, references, density, quality, cleaning.

Whole words are taken with a Unicode class and then filtered, never with a word boundary, whose meaning differs between engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{N}_]+"

# Code forms of regulations that stay whole as tokens.
CODE_PATTERNS = (
    r"cs(?:-[a-z]+)?[\s\-]?\d+[a-z]?(?:[.\-]\d+[a-z]?)?(?:\([a-z0-9]+\))*",
    r"amc\d{0,2}(?:-[a-z]+)?[\s\-]?\d+[a-z]?(?:[.\-]\d+[a-z]?)?(?:\([a-z0-9]+\))*",
    r"gm\d{0,2}(?:-[a-z]+)?[\s\-]?\d+[a-z]?(?:[.\-]\d+[a-z]?)?(?:\([a-z0-9]+\))*",
    r"(?:far|faa)[\s\-]?\d+[.\-]\d+",
    r"fcl[.\-]?\d+(?:\.[a-z]+(?:\.\d+)?)?",
    r"(?:cat|oro|spa|nco|ncc|spo)\.[a-z]+(?:\.[a-z]+)*\.\d+",
)
# Words left out of the lexical index (normative words stay in).
INDEX_STOPWORDS = (
    "the a an is are was were be been have has had do does did will would could can this that these those it its of to in for on with at by from "
    "and or but if then else when where le la les un une des de du et ou also any each which who whom whose more most other some such than too very"
).split()
# Words left out of question keywords.
QUESTION_STOPWORDS = (
    "le la les un une des de du au aux ce cette ces mon ma mes ton ta tes son sa ses notre nos votre vos leur leurs je tu il elle on nous vous ils elles "
    "qui que quoi dont où quel quelle quels quelles et ou mais donc car ni or dans sur sous avec sans pour par en vers est sont être avoir fait faire peut doit "
    "a ai as avons avez ont ne pas plus moins très bien aussi comment pourquoi quand combien "
    "the a an is are was were be been being have has had do does did will would could should may might must shall can i you he she it we they me him her us them "
    "my your his its our their this that these those what which who whom whose where when why how and or but if then else so because in on at to for of with by "
    "from about not no yes all any some each every"
).split()
# Words left out of chunk keywords.
CHUNK_STOPWORDS = (
    "le la les un une des du de et ou en est sont être avoir pour par avec dans sur ce cette ces qui que dont où ne pas plus tout tous toute toutes autre autres même "
    "aussi très bien peut doit fait faire comme mais si the a an and or is are be to of in for on with at by from this that these those it its as but if not no so can "
    "will would could should may must have has been being was were which what when where"
).split()
# Recommended chunk sizes by density.
CHUNK_SIZES = {"very_dense": 800, "dense": 1200, "normal": 1500, "sparse": 2000}
# What marks a sentence that defines or requires.
DEFINES = r"(?i)means|is defined as|refers to|shall be|is the"
REQUIRES = r"(?i)shall|must|require|mandatory"
# Signs of a dense text (pattern, count that must be exceeded, weight); the words of a short sentence; the weight of mostly short ones.
DENSE_SIGNS = (
    (r"(?i)\b(?:FCL|CAT|ORO|Part|AMC)\.\w+", 2, 0.3),
    (r"(?i)[0-9]+\s*(?:heures?|h|ans?|jours?|mois|%)", 3, 0.2),
    (r"(?m)^\s*[-–—•(]\s*", 5, 0.2),
)
SHORT_SENTENCE, SHORT_WEIGHT = 15, 0.3
# Families of references (name, pattern), the reference as all groups that are not empty.
REFERENCE_FAMILIES = (
    ("regulation", r"(?i)\b((?:CS(?:-[A-Z]+)?|AMC[0-9]{0,2}|GM[0-9]{0,2})[-\s]?[0-9]+[A-Z]?(?:[.\-][0-9]+[A-Za-z]?)?(?:\([a-z0-9]+\))*)"),
    ("operations", r"(?i)\b((?:CAT|ORO|SPA|NCO|NCC|SPO)\.[A-Z]+(?:\.[A-Z]+)*\.[0-9]+)"),
    ("licensing", r"(?i)\b(FCL[.\-]?[0-9]+(?:\.[A-Z]+)?)"),
    ("introduced", r"(?i)(?:see|refer\s+to|in\s+accordance\s+with|as\s+per|per|according\s+to|compliance\s+with|compliant\s+with)\s+((?:CS(?:-[A-Z]+)?|AMC[0-9]{0,2}|GM[0-9]{0,2})[-\s]?[0-9]+[A-Z]?(?:[.\-][0-9]+[A-Za-z]?)?)"),
    ("foreign", r"(?i)\b((?:FAR|JAR|FAA)[-\s]?[0-9]+(?:[.\-][0-9]+)*)"),
    ("internal", r"(?i)(?:paragraph|sub-paragraph|section|point|alinéa)\s*(\([a-z0-9]+\)(?:\([a-z0-9]+\))?)"),
    ("appendix", r"(?i)(Appendix\s+[A-Z0-9]+)"),
)
REGULATION_REF = r"(?i)(?:CS|AMC|GM)[-\s]?\d+(?:[.\-]\d+)*[A-Za-z]?"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text: Column | str) -> Column:
    """Whole words of the lower-cased text."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(WORDS), 0)


def index_tokens(text: Column | str) -> Column:
    """Tokens of the lexical index: codes first (white space in them made a hyphen), then words and numbers of two characters or
    more without stopwords. Null and empty texts have none."""
    low = F.lower(_c(text))
    codes = [F.transform(F.regexp_extract_all(low, F.lit(p), 0), lambda x: F.regexp_replace(F.trim(x), r"\s+", "-")) for p in CODE_PATTERNS]
    plain = F.filter(words(text), lambda w: w.rlike(r"^([a-z]{2,}|[0-9]{2,})$") & ~w.isin(INDEX_STOPWORDS))
    return F.coalesce(F.concat(*codes, plain), F.array().cast("array<string>"))


def question_keywords(text: Column | str, least: int = 3) -> Column:
    """Codes in upper case first, then words without stopwords, each once."""
    low = F.lower(_c(text))
    codes = F.transform(F.regexp_extract_all(low, F.lit(r"(?:cs-apu|cs-e|cs|amc|gm)[\s\-]?\d+(?:\.\d+)*"), 0), lambda x: F.replace(F.upper(x), F.lit(" "), F.lit("-")))
    plain = F.filter(F.regexp_extract_all(low, F.lit(r"[a-zà-ÿ0-9\-]+"), 0), lambda w: ~w.isin(QUESTION_STOPWORDS) & ((F.length(w) >= least) | w.rlike(r"^[0-9]+$")))
    kept = F.filter(plain, lambda w: ~F.array_contains(codes, F.upper(w)))
    return F.array_distinct(F.concat(codes, kept))


def keyword_matches(text: Column | str, keywords: Column) -> Column:
    """How many keywords occur in the text, as parts of words too."""
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    return F.size(F.filter(keywords, lambda k: F.contains(low, F.lower(k))))


def section_refs(section: Column | str) -> Column:
    """References of a section id (several are parted by |), lower-cased without spaces and hyphens."""
    parts = F.transform(F.split(F.coalesce(_c(section), F.lit("")), r"\|"), lambda s: F.regexp_replace(F.lower(F.trim(s)), r"[\s\-]+", ""))
    return F.filter(parts, lambda s: s != "")


def refs_match(refs: Column, entities: Column) -> Column:
    """A reference equals an entity, or one begins with the other and goes on with a point or bracket."""

    def begins(a, b):
        rest = F.substring(a, F.length(b) + 1, F.lit(1))
        return F.startswith(a, b) & rest.isin("", ".", "(")

    return F.exists(refs, lambda r: F.exists(entities, lambda e: begins(r, e) | begins(e, r)))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def density_score(text: Column | str, vocabulary: list[str]) -> Column:
    """How dense a text is, 0 to 1: technical words, numbers, lists, references, capitals, brackets and short sentences.

    Texts under 50 characters have 0.5.
    """
    t = _c(text)
    low_words = F.filter(F.regexp_extract_all(F.lower(t), F.lit(WORDS), 0), lambda w: w.rlike(r"^[a-zà-ÿ]{2,}$"))
    n = F.greatest(F.size(low_words), F.lit(1))
    size = F.greatest(F.length(t), F.lit(1))
    sentences = F.filter(F.transform(F.split(t, r"[.!?]+"), lambda s: F.trim(s)), lambda s: s != "")
    mean = F.aggregate(sentences, F.lit(0).cast("long"), lambda a, s: a + F.length(s)) / F.greatest(F.size(sentences), F.lit(1))
    technical = F.size(F.filter(low_words, lambda w: w.isin(vocabulary))) / n
    numeric = (_count(t, r"[0-9]+(?:\.[0-9]+)?") + _count(t, r"[=<>≤≥±×÷∑∏√∫]") * 3) / size * 100
    lists = _count(t, r"(?m)^[ \t]*[-*•][ \t]+|\([ ]*[a-z0-9]+[ ]*\)|[0-9]+[.)][ ]+") / F.greatest(F.size(sentences), F.lit(1))
    refs = _count(t, REGULATION_REF) / n * 100
    upper = F.size(F.filter(F.regexp_extract_all(t, F.lit(WORDS), 0), lambda w: w.rlike(r"^[A-Z]{2,}$"))) / n
    brackets = _count(t, r"[()\[\]{}]") / size * 100
    total = technical * 2.0 + F.least(numeric, F.lit(5.0)) / 5 * 1.5 + F.least(lists, F.lit(2.0)) / 2 + F.least(refs, F.lit(3.0)) / 3 * 1.5 + upper + F.least(brackets, F.lit(3.0)) / 3 + (1 - F.least(mean, F.lit(200.0)) / 200) * 0.5
    return F.when(t.isNull() | (F.length(t) < 50), F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / 8.5)))


def density_type(text: Column | str, score: Column) -> Column:
    t = _c(text)
    return F.when(t.isNull() | (F.length(t) < 50), "normal").when(score >= 0.5, "very_dense").when(score >= 0.3, "dense").when(score >= 0.15, "normal").otherwise("sparse")


def adaptive_size(kind: Column, base: int = 1500, least: int = 600, most: int = 2500) -> Column:
    size = F.lit(CHUNK_SIZES["sparse"])
    for k in ("normal", "dense", "very_dense"):
        size = F.when(kind == k, CHUNK_SIZES[k]).otherwise(size)
    return F.least(F.lit(most), F.greatest(F.lit(least), F.floor(base * size / 1500))).cast("int")


def semantic_density(text: Column | str) -> Column:
    """The weights of the signs of density that a text shows, and of mostly short sentences."""
    t = F.coalesce(_c(text), F.lit(""))
    words_of = F.transform(F.split(t, "[.!?]", -1), lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")))
    short = F.size(F.filter(words_of, lambda n: n < SHORT_SENTENCE)) / F.size(words_of)
    shown = [F.when(_count(t, p) > most, weight).otherwise(0.0) for p, most, weight in DENSE_SIGNS]
    return sum(shown, F.when(short > 0.5, SHORT_WEIGHT).otherwise(0.0))


def is_suspect(text: Column | str, least: int = 500) -> Column:
    """Empty, short, or with under 85 per cent printable characters."""
    t = F.coalesce(_c(text), F.lit(""))
    shown = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}\p{P}\p{S}\p{M} \n\r\t]", ""))
    return (t == "") | (F.length(t) < least) | (shown / F.greatest(F.length(t), F.lit(1)) < 0.85)


# Patterns of noise, of which more than three finds count: broken ligatures, runs of signs, runs of capitals, repeated characters.
NOISE = (r"[ﬀﬁﬂﬃﬄ]{2,}", r"[^\p{L}\p{N}_\s.,;:!?'\"()-]{5,}", r"(?i)[A-Z]{20,}", r"(?i)(.)\1{4,}")


def extraction_issues(text: Column | str) -> Column:
    """The names of what is wrong with an extracted text: unprintable, few_letters, ligatures, symbols, capitals, repeats, vowelless, few_words,
    short_lines, spaces. An empty text has none."""
    t = F.coalesce(_c(text), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    ws = F.regexp_extract_all(F.lower(t), F.lit(WORDS), 0)
    lines = F.split(t, "\n")
    wide = _count(t, " {3,}")
    signs = {
        "unprintable": F.length(F.regexp_replace(t, r"[^\p{L}\p{N}\p{P}\p{S}\p{M} \n\r\t]", "")) / n < 0.85,
        "few_letters": F.length(F.regexp_replace(t, r"[^\p{L}]", "")) / n < 0.4,
        **{name: _count(t, p) > 3 for name, p in zip(("ligatures", "symbols", "capitals", "repeats"), NOISE)},
        "vowelless": F.size(F.filter(ws, lambda w: w.rlike(r"^[bcdfghjklmnpqrstvwxz]{6,}$"))) > 3,
        "few_words": F.size(F.filter(ws, lambda w: w.rlike(r"^[a-zà-ÿ]{2,}$"))) / n * 1000 < 50,
        "short_lines": F.size(F.filter(lines, lambda s: (F.length(F.trim(s)) > 0) & (F.length(F.trim(s)) < 5))) / F.size(lines) > 0.3,
        "spaces": F.when(F.length(t) > 1000, wide / (n / 1000)).otherwise(wide) > 10,
    }
    found = F.array_compact(F.array(*[F.when(c, name) for name, c in signs.items()]))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(found)


def extraction_quality(text: Column | str) -> Column:
    """1 less penalties for unprintable characters, few letters, noise patterns, few words and many short lines; 0 for no text."""
    t = F.coalesce(_c(text), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    shown = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}\p{P}\p{S}\p{M} \n\r\t]", "")) / n
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", "")) / n
    noise = sum(
        (F.when(_count(t, p) > 3, 1).otherwise(0) for p in NOISE),
        F.lit(0),
    )
    vowelless = F.size(F.filter(F.regexp_extract_all(F.lower(t), F.lit(WORDS), 0), lambda w: w.rlike(r"^[bcdfghjklmnpqrstvwxz]{6,}$")))
    noise = noise + F.when(vowelless > 3, 1).otherwise(0)
    found = F.size(F.filter(F.regexp_extract_all(F.lower(t), F.lit(WORDS), 0), lambda w: w.rlike(r"^[a-zà-ÿ]{2,}$"))) / n * 1000
    lines = F.split(t, "\n")
    short = F.size(F.filter(lines, lambda s: (F.length(F.trim(s)) > 0) & (F.length(F.trim(s)) < 5))) / F.size(lines)
    s = (
        F.lit(1.0)
        - F.when(shown < 0.95, (0.95 - shown) * 2).otherwise(0.0)
        - F.when(letters < 0.5, (0.5 - letters) * 1.5).otherwise(0.0)
        - noise * 0.1
        - F.when(found < 100, (100 - found) / 200).otherwise(0.0)
        - F.when(short > 0.2, (short - 0.2) * 0.5).otherwise(0.0)
    )
    return F.when(t == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))


def quality_level(score: Column) -> Column:
    return F.when(score >= 0.9, "excellent").when(score >= 0.75, "good").when(score >= 0.5, "fair").when(score >= 0.25, "poor").otherwise("unusable")


def ocr_confidence(text: Column | str) -> Column:
    t = F.coalesce(_c(text), F.lit(""))
    n = F.length(t)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", "")) / F.greatest(n, F.lit(1))
    cut = F.when(n < 100, 0.3).when(n < 500, 0.1).otherwise(0.0) + F.least(F.lit(0.4), 0.1 * _count(t, r"\[illisible\]")) + F.when(letters < 0.3, 0.2).otherwise(0.0)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - cut))


def clean_lines(text: Column | str, watermarks: tuple[str, ...] = (r"(?i)^.*(?:printed copies|copie non tenu|all rights kept).*$",)) -> Column:
    """Watermark lines and lines of up to three capitals or digits go; blank lines stay."""
    lines = F.split(_c(text), "\n")
    keep = F.filter(lines, lambda s: (F.trim(s) == "") | ~(F.trim(s).rlike(r"^[A-Z0-9]{1,3}$") | _any(F.trim(s), watermarks)))
    return F.trim(F.array_join(keep, "\n"))


def _any(s: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | s.rlike(p)
    return out


def single_spaces(text: Column | str) -> Column:
    """Spaces and tabs within a line become one space, lines are trimmed, empty lines go."""
    lines = F.transform(F.split(_c(text), r"\r?\n"), lambda s: F.trim(F.regexp_replace(s, r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def paragraphs(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(_c(text), r"\n[ \t\r\n]*\n"), lambda s: F.regexp_replace(s, r"^[ \t\r\n]+|[ \t\r\n]+$", "")), lambda s: s != "")


def pages(text: Column | str) -> Column:
    return F.split(_c(text), "\f")


def key_phrases(text: Column | str, most: int = 5) -> Column:
    """Sentences that define, then sentences that require, of 21 to 299 characters, each once."""
    t = F.coalesce(_c(text), F.lit(""))
    sentences = F.regexp_extract_all(t, F.lit("[^.]*[.]"), 0)
    found = F.concat(F.filter(sentences, lambda s: s.rlike(DEFINES)), F.filter(sentences, lambda s: s.rlike(REQUIRES)))
    trimmed = F.transform(found, lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    good = F.array_distinct(F.filter(trimmed, lambda s: (F.length(s) > 20) & (F.length(s) < 300)))
    return F.when(F.length(t) < 50, F.array().cast("array<string>")).otherwise(F.slice(good, 1, most))


def html_text(html: Column | str) -> Column:
    """Plain text of simple HTML by patterns: scripts and styles go, block ends become line ends, tags go, common entities are resolved."""
    t = F.regexp_replace(_c(html), r"(?is)<(script|style|noscript)[^>]*>.*?</(?:script|style|noscript)>", "")
    t = F.regexp_replace(t, r"(?i)<br[ ]*/?>|</p>|</div>|</li>|</h[1-6]>|</tr>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n[ \n]*\n", "\n\n"))


def refers_to(text: Column | str) -> Column:
    """Distinct normalised regulation references of a text (upper case, no spaces or hyphens), in order of first appearance."""
    found = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(r"(?:CS(?:-[A-Z]+)?|AMC[0-9]{0,2}|GM[0-9]{0,2}|FAR|JAR)[- ]?[0-9]+[A-Z]?(?:[.\-][0-9]+[A-Za-z]?)?(?:\([a-z0-9]+\))*"), 0)
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.upper(x), r"[ \-]", "")))


def references(text: Column | str) -> Column:
    """Array of (ref, family, position): the references of all families, each normalised id (upper case, no spaces or hyphens) once, by the
    first family and place that has it; positions count from 1."""
    t = F.coalesce(_c(text), F.lit(""))


    def found(name: str, pattern: str) -> Column:
        at = lambda x: F.instr(t, x).alias("position")
        return F.transform(F.regexp_extract_all(t, F.lit(pattern), 1), lambda x: F.struct(F.regexp_replace(F.upper(x), r"[\s\-]", "").alias("ref"), F.lit(name).alias("family"), at(x)))

    every = F.concat(*[found(name, p) for name, p in REFERENCE_FAMILIES])
    names = F.array_distinct(F.transform(every, lambda x: x["ref"]))
    return F.transform(names, lambda n: F.element_at(F.filter(every, lambda x: x["ref"] == n), 1))


def chunk_metadata(text: Column | str) -> Column:
    """has_header, list_items, refs (distinct, in order), word_density of a chunk."""
    t = F.coalesce(_c(text), F.lit(""))
    header = _any(t, (r"(?m)^(?:[0-9]+\.)+\s+[A-ZÀÉÈ]", r"(?mi)^(?:Article|Chapitre|Chapter)\s+[0-9]+", r"(?mi)^(?:CS|AMC|GM)(?:[0-9]{0,2}|-[A-Z]+)?[\s\-]+[0-9]+", r"(?m)^(?:Annex|Annexe|Appendix|APPENDIX)\s+[A-Z0-9]+"))
    items = sum((_count(t, p) for p in (r"(?m)^\s*[-–—•]\s+", r"(?m)^\s*\([a-z]\)\s+", r"(?m)^\s*[0-9]+\)\s+")), F.lit(0))
    refs = F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?i)\b(?:FCL|CAT|ORO|NCO|AMC|GM|CS|Part)[.\-]?[0-9]+(?:\.[A-Z]+\.[0-9]+)?"), 0))
    n = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return F.struct(header.alias("has_header"), items.alias("list_items"), refs.alias("refs"), (n / F.greatest(F.length(t), F.lit(1))).alias("word_density"))


def enriched(text: Column | str, keywords: Column) -> Column:
    """The text under a line of its keywords; without keywords the text itself. It is for reading: what is embedded is the text."""
    return F.when(F.size(F.coalesce(keywords, F.array().cast("array<string>"))) > 0, F.concat(F.lit("[Keywords: "), F.array_join(keywords, " | "), F.lit("]\n\n"), _c(text))).otherwise(_c(text))


# What a generator's failure says.
FAILED_ANSWERS = ("ERREUR DE COMMUNICATION AVEC LE LLM", "Le serveur n'a pas pu répondre", "Veuillez reposer votre question")


def failed_answer(answer: Column | str) -> Column:
    """Whether an answer is the message of a generator that failed; null and empty answers are not."""
    return F.coalesce(_any_of(_c(answer), FAILED_ANSWERS), F.lit(False))


def _any_of(c: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the and of to is with for by that be shall are this from".split(),
    "fr": "le la les des et du une est pour dans sur avec par que".split(),
    "de": "der die das und mit ist von nicht den im wird für auf ein".split(),
    "es": "el los las y una con para se del que por su como más".split(),
    "it": "il gli di che una per con della si nel sono del come più".split(),
}


def language(text: Column | str, least: int = 50) -> Column:
    """The language whose function words a text has most (ties in the order of the table), unk for short texts and for those without any.

    Whole texts are read. Words of two languages count for both.
    """
    t = _c(text)
    ws = words(t)
    count = lambda v: F.size(F.filter(ws, lambda w: w.isin(v)))
    n = {lang: count(v) for lang, v in FUNCTION_WORDS.items()}
    top = F.greatest(*n.values())
    out = F.lit("unk")
    for lang in reversed(list(n)):
        out = F.when(n[lang] == top, lang).otherwise(out)
    return F.when(t.isNull() | (F.length(t) < least) | (top == 0), "unk").otherwise(out)


def clean_file_name(name: Column | str) -> Column:
    """A file name of plain letters, digits, dots, hyphens and underscores: marks of letters go, other signs become one underscore."""
    plain = F.translate(F.coalesce(_c(name), F.lit("")), *ACCENTS)
    return F.regexp_replace(F.regexp_replace(plain, r"[^A-Za-z0-9._\-]+", "_"), r"^_+|_+$", "")


def offline_context(context: Column | str, most: int = 8000) -> Column:
    """A context for a small local model: cut at `most` characters with a mark, block headers with numbered chunks gone, gaps made even."""
    c = F.coalesce(_c(context), F.lit(""))
    cut = F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("\n[...]"))).otherwise(c)
    bare = F.regexp_replace(cut, r"\[source=[^\]]*chunk=[0-9]+[^\]]*\]\n?", "")
    return F.trim(F.regexp_replace(bare, r"\n{3,}", "\n\n"))


def sub_questions(reply: Column | str, question: Column | str, most: int = 5) -> Column:
    """The lines of a generator's reply that are long enough for a question (over ten characters), numbering taken away; else the question."""
    lines = F.transform(F.split(F.coalesce(_c(reply), F.lit("")), "\n"), lambda s: F.trim(F.regexp_replace(s, r"^\s*(?:[0-9]+[.)]|[-*•])\s*", "")))
    good = F.slice(F.filter(lines, lambda s: F.length(s) > 10), 1, most)
    return F.when(F.size(good) > 0, good).otherwise(F.array(_c(question)))


def wiki_base(url: Column | str) -> Column:
    """(base, context) of a wiki address: the context path is that before the first known marker."""
    u = _c(url)
    base = F.regexp_extract(u, r"^(https?://[^/]+)", 1)
    return F.struct(base.alias("base"), F.regexp_extract(u, r"^https?://[^/]+(/[^/]+)?/(?:spaces|display|pages|rest|x)(?:/|$)", 1).alias("context"))


def valid_path(path: Column | str) -> Column:
    """A path that does not climb out of its folder."""
    p = _c(path)
    return F.coalesce((F.trim(p) != "") & ~p.rlike(r"(?:^|[/\\])\.\.(?:[/\\]|$)"), F.lit(False))


def ocr_route(quality: Column, has_engine: Column, forced: Column, confidence: Column, threshold: float = 0.5) -> Column:
    """Which text of a file is kept: classic, classic_fallback (bad, but nothing to read it with), llm_ocr (forced, or bad and read better)
    or classic_kept (bad, but the reading was no better)."""
    bad = F.coalesce(quality, F.lit(0.0)) < threshold
    better = F.coalesce(confidence, F.lit(0.0)) > F.coalesce(quality, F.lit(0.0))
    return F.when(~has_engine, F.when(bad, "classic_fallback").otherwise("classic")).when(forced, "llm_ocr").when(~bad, "classic").when(better, "llm_ocr").otherwise("classic_kept")


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def attachment_path(parent: Column | str, name: Column | str) -> Column:
    """dir/stem-name, where parent is dir/stem.ext."""
    return F.concat(F.regexp_replace(_c(parent), r"\.[^./]*$", ""), F.lit("-"), _c(name))


def safe_url(url: Column | str) -> Column:
    """http or https to a public host: no localhost, no metadata names, no literal private or link-local address."""
    u = _c(url)
    host = F.lower(F.coalesce(F.try_parse_url(u, F.lit("HOST")), F.lit("")))
    scheme = F.lower(F.coalesce(F.try_parse_url(u, F.lit("PROTOCOL")), F.lit("")))
    private = host.rlike(r"^(?:localhost|.*\.local|.*\.internal|0\.0\.0\.0|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(?:1[6-9]|2[0-9]|3[01])\..*|\[.*\])$")
    return F.coalesce(scheme.isin("http", "https") & (host != "") & ~private, F.lit(False))


# Letters with marks and what they lose.
ACCENTS = ("àâäáãéèêëíìîïóòôöõúùûüçñÀÂÄÁÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇÑ", "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN")


def collection_name(name: Column | str, most: int = 50) -> Column:
    """Letters without marks, digits and underscores only, lower case, at most `most` characters."""
    plain = F.translate(F.coalesce(_c(name), F.lit("")), *ACCENTS)
    return F.substring(F.regexp_replace(F.lower(F.regexp_replace(plain, r"[^A-Za-z0-9]+", "_")), r"^_+|_+$", ""), 1, most)


def chunk_id(source: Column | str, section: Column | str, number: Column | str) -> Column:
    """file_section_number, or file_semantic_number without a section."""
    safe = F.substring(F.regexp_replace(F.coalesce(_c(section), F.lit("semantic")), r"[^A-Za-z0-9.()\-]+", "_"), 1, 50)
    return F.concat_ws("_", _c(source), safe, _c(number).cast("string"))


def table_text(rows: Column) -> Column:
    """An array of rows (arrays of cells) as a text table: cells padded to their column's width, a rule after the first row."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))))
    columns = F.sequence(F.lit(1), F.greatest(F.lit(1), F.array_max(F.transform(clean, lambda r: F.size(r)))))
    cell = lambda r, i: F.coalesce(F.get(r, i - 1), F.lit(""))
    width = lambda i: F.greatest(F.lit(1), F.array_max(F.transform(clean, lambda r: F.length(cell(r, i)))))
    lines = F.transform(clean, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(columns, lambda i: F.rpad(cell(r, i), width(i), " ")), " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(columns, lambda i: F.repeat(F.lit("-"), width(i))), " | "), F.lit(" |"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.lit(0), F.size(lines) - 1))), "\n")).otherwise("")
