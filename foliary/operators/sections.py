"""Sections of regulatory text, without leaving the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_sections(df: DataFrame, id_col: str, text_col: str, header: str) -> DataFrame:
    """id, section_no (from 0), section_id, title, body: a section runs from its header line to the next one; text before the first
    header is left out; an empty body is kept. Null texts give no section. header: a pattern with the kind as group 1, the number as
    group 3 and the title as group 4."""
    lines = df.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("no", "line"))
    lines = lines.withColumn("head", F.col("line").rlike(header))
    lines = lines.withColumn("sec", F.sum(F.col("head").cast("int")).over(Window.partitionBy(id_col).orderBy("no"))).where("sec > 0")
    name = F.concat_ws(" ", F.regexp_extract("line", header, 1), F.regexp_extract("line", header, 3))
    rows = lines.groupBy(id_col, "sec").agg(
        F.max(F.when(F.col("head"), name)).alias("section_id"),
        F.max(F.when(F.col("head"), F.trim(F.regexp_extract("line", header, 4)))).alias("title"),
        F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("no", "line")))).alias("x"),
    )
    return rows.select(id_col, (F.col("sec") - 1).cast("int").alias("section_no"), "section_id", "title", F.trim(F.array_join(F.transform("x", lambda v: v["line"]), "\n")).alias("body"))


# Forms of a section code in structured files, by name; the code is group 1.
CODE_FORMS = {
    "cs": r"(?i)(CS[-\s]?[0-9]+[A-Z]?[-.]?[0-9]+(?:\.[0-9]+)?(?:\s*\([a-z]\))?)",
    "amc": r"(?i)(AMC[-\s]?[0-9]+[A-Z]?[-.]?[0-9]+(?:\.[0-9]+)?(?:\s*\([a-z]\))?)",
    "cs_e": r"(?i)(CS[-\s]?E[-\s]?[0-9]+(?:\.[0-9]+)?(?:\s*\([a-z]\))?)",
    "cs_apu": r"(?i)(CS[-\s]?APU[-\s]?[0-9]+(?:\.[0-9]+)?(?:\s*\([a-z]\))?)",
    "gm": r"(?i)(GM[-\s]?[0-9]+[A-Z]?[-.]?[0-9]+(?:\.[0-9]+)?(?:\s*\([a-z]\))?)",
    "all": r"(?i)((?:CS[-\s]?[0-9]+[A-Z]?[-.]?[0-9]+|AMC[-\s]?[0-9]+[A-Z]?[-.]?[0-9]+|CS[-\s]?E[-\s]?[0-9]+|CS[-\s]?APU[-\s]?[0-9]+|GM[-\s]?[0-9]+[A-Z]?[-.]?[0-9]+)(?:\.[0-9]+)?(?:\s*\([a-z]\))?)",
}


def code_sections(df: DataFrame, id_col: str, text_col: str, form: str = CODE_FORMS["all"]) -> DataFrame:
    """id, section_no (from 0), code, title, body: a section runs from a code, wherever it stands, to the next one; what stands before the
    first is left out. The title is the rest of the code's line, else the line after it, cut at 100 characters. A text without a code is one
    section DOCUMENT without a title; null texts give none. Each text is cut within its row: nothing is exchanged."""
    mark = "\u0001"
    parts = F.split(F.regexp_replace(text_col, form, mark + "$1"), mark)
    has = F.size(parts) > 1
    rows = df.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.when(has, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts)).alias("section_no", "body"), has.alias("_has"))
    code = F.regexp_extract("body", form, 1)
    lines = F.split(F.substring("body", F.length(code) + 1, F.length("body")), "\n")
    line = lambda i: F.coalesce(F.trim(F.regexp_replace(F.get(lines, F.lit(i)), r"[\r\t]", " ")), F.lit(""))
    title = F.substring(F.when(line(0) != "", line(0)).otherwise(line(1)), 1, 100)
    return rows.select(id_col, "section_no", F.when(F.col("_has"), F.upper(code)).otherwise("DOCUMENT").alias("code"), F.when(F.col("_has"), title).otherwise("").alias("title"), F.trim("body").alias("body"))


def code_section_chunks(sections: DataFrame, least: int = 50) -> DataFrame:
    """Sections of at least `least` characters with their code and title in front of the text, as chunks."""
    head = F.when(F.col("title") != "", F.concat_ws(" - ", "code", "title")).otherwise(F.col("code"))
    return sections.where(F.length("body") >= least).withColumn("text", F.concat(head, F.lit("\n\n"), F.col("body")))


def section_summary(sections: DataFrame, id_col: str) -> DataFrame:
    """id, section_no, code, title (50 characters), length, preview (150 characters, on one line)."""
    return sections.select(id_col, "section_no", "code", F.substring("title", 1, 50).alias("title"), F.length("body").alias("length"), F.substring(F.regexp_replace("body", r"\s+", " "), 1, 150).alias("preview"))


# Fixed value: the signs that are blank at the ends of a line.
BLANK = "".join(filter(str.isspace, map(chr, range(0x3001))))


def without_repeated_lines(df: DataFrame, id_col: str, text_col: str, share: float = 0.7, least_pages: int = 3) -> DataFrame:
    """id, text: texts of form-feed parted pages without the first lines that are first, and the last lines that are last, on int(share * pages)
    of their pages.

    Lines are counted as the first and as the last non-blank one of each page, apart from each other (over two characters, in texts of at
    least least_pages pages); what is taken away is a page's raw first or last line. The other lines of such texts stay, ended by line feeds;
    texts of fewer pages stay as they are, null texts null. Pages are looked at within their row.
    """
    strip = lambda s: F.trim(s, F.lit(BLANK))
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  # the value is found once, not at every turn of a loop
    rows = df.select(id_col, F.col(text_col).alias("_t"), F.split(F.regexp_replace(text_col, r"\r\n?", "\n"), "\f").alias("_p"))
    least = F.greatest(F.lit(1), F.floor(share * F.size("_p"))).cast("int")

    def often(end):  # in order, a line recurs often enough if the same one stands least - 1 places on
        ends = F.array_sort(F.filter(F.transform("_p", lambda p: strip(F.substring_index(strip(p), "\n", end))), lambda x: F.length(x) > 2))
        return let(ends, lambda e: F.array_distinct(F.filter(e, lambda x, i: F.get(e, i + least - 1) == x)))

    def bare(lines, first, last):
        a = F.when(F.array_contains(first, strip(F.element_at(lines, 1))), 2).otherwise(1)
        b = F.size(lines) - F.when(F.array_contains(last, strip(F.element_at(lines, -1))), 1).otherwise(0)
        return F.array_join(F.slice(lines, a, F.greatest(F.lit(0), b - a + 1)), "\n")

    pages = let(often(1), lambda first: let(often(-1), lambda last: F.transform("_p", lambda p: let(F.split(p, "\n"), lambda x: bare(x, first, last)))))
    return rows.select(id_col, F.when(F.size("_p") >= least_pages, F.array_join(pages, "\f")).otherwise(F.col("_t")).alias("text"))
