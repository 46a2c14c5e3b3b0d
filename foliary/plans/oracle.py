"""DuckDB forms of the text expressions, for the SQL twins of the queries."""

from __future__ import annotations

from foliary.functions import text as T


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def many(words) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {lit(T.WORDS)})"


def words_like(x: str, pattern: str) -> str:
    return f"list_filter({words(x)}, lambda w: regexp_matches(w, {lit(pattern)}))"


def index_tokens(x: str) -> str:
    codes = [f"list_transform(regexp_extract_all(lower({x}), {lit(p)}), lambda c: regexp_replace(trim(c), '\\s+', '-', 'g'))" for p in T.CODE_PATTERNS]
    plain = f"list_filter({words_like(x, '^([a-z]{2,}|[0-9]{2,})$')}, lambda w: not list_contains({many(T.INDEX_STOPWORDS)}, w))"
    return f"coalesce(list_concat({', '.join(codes)}, {plain}), [])"


def question_keywords(x: str, least: int = 3) -> str:
    codes = f"list_transform(regexp_extract_all(lower({x}), '(?:cs-apu|cs-e|cs|amc|gm)[\\s\\-]?\\d+(?:\\.\\d+)*'), lambda c: replace(upper(c), ' ', '-'))"
    plain = f"list_filter(regexp_extract_all(lower({x}), '[a-zà-ÿ0-9\\-]+'), lambda w: not list_contains({many(T.QUESTION_STOPWORDS)}, w) and (length(w) >= {least} or regexp_matches(w, '^[0-9]+$')))"
    return distinct(f"list_concat({codes}, list_filter({plain}, lambda w: not list_contains({codes}, upper(w))))")


def distinct(x: str) -> str:
    """Ordered distinct."""
    return f"(list_reduce(list_prepend([]::varchar[], list_transform({x}, lambda v: [v])), lambda a, v: case when list_contains(a, v[1]) then a else list_append(a, v[1]) end))"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(pattern)}))"


def refers_to(x: str) -> str:
    found = f"regexp_extract_all(coalesce({x}, ''), '(?:CS(?:-[A-Z]+)?|AMC[0-9]{{0,2}}|GM[0-9]{{0,2}}|FAR|JAR)[- ]?[0-9]+[A-Z]?(?:[.\\-][0-9]+[A-Za-z]?)?(?:\\([a-z0-9]+\\))*')"
    return distinct(f"list_transform({found}, lambda r: regexp_replace(upper(r), '[ \\-]', '', 'g'))")


def section_refs(x: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({x}, ''), '|'), lambda s: regexp_replace(lower(trim(s)), '[\\s\\-]+', '', 'g')), lambda s: s <> '')"


def squared_l2(a: str, b: str, dim: int = 64) -> str:
    return f"list_sum(list_transform(range(1, {dim + 1}), lambda i: ({a}[i]::double - {b}[i]::double) * ({a}[i]::double - {b}[i]::double)))"


def ratio_sum(parts: list[str]) -> str:
    return " + ".join(parts)
