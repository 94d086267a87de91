"""Text functions as columns, each with the SQL text that gives the same values in DuckDB.

Patterns are written once, with \\b for an ASCII word boundary: DuckDB's \\b is
one, Java's isn't, so it is spelled out for Spark. White space is that of
JavaScript, written as one explicit class for both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def js(pattern: str) -> str:
    """The pattern for Java with ASCII word boundaries."""
    return pattern.replace(r"\b", _EDGE)


def q(pattern: str) -> str:
    """The pattern as a SQL string."""
    return "'" + pattern.replace("'", "''") + "'"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, however often body uses it.

    Without it the optimizer writes the whole expression of value into every
    place, inner loops of higher-order functions included.
    """
    return F.transform(F.array(value), body)[0]


def matches(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(js(pattern)))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(js(pattern)))


def found(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(js(pattern)), F.lit(0))


def matches_sql(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def count_sql(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {q(pattern)}))"


# Redaction. The formats, in the order in which they are tried.

REDACTIONS = [
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("PHONE", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"),
    ("SSN", r"\b\d{3}-?\d{2}-?\d{4}\b"),
    ("CREDITCARD", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"),
    ("IPADDRESS", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
]
LOGGED = [
    *REDACTIONS,
    ("JWT", r"\beyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*\b"),
    ("APIKEY", r"\b[Ss][Kk]-[A-Za-z0-9]{20,}\b"),
]
#: Keys whose values are never logged, in lower case.
SENSITIVE = ("password", "token", "secret", "key", "apikey", "accesstoken", "refreshtoken", "sessiontoken", "privatekey", "certificate")


def redact(c: Column, rules=REDACTIONS) -> Column:
    for name, pattern in rules:
        c = F.regexp_replace(c, js(pattern), f"[REDACTED_{name}]")
    return c


def redact_sql(c: str, rules=REDACTIONS) -> str:
    for name, pattern in rules:
        c = f"regexp_replace({c}, {q(pattern)}, '[REDACTED_{name}]', 'g')"
    return c


def redact_map(c: Column) -> Column:
    """A map with the values of sensitive keys replaced and the others redacted."""
    hidden = lambda k: F.lower(k).isin(*SENSITIVE) | F.contains(F.lower(k), F.lit("password")) | F.contains(F.lower(k), F.lit("secret"))
    return F.transform_values(c, lambda k, x: F.when(hidden(k), F.lit("[REDACTED_SENSITIVE]")).otherwise(redact(x)))


# Validation


def violations() -> Column:
    """Names of the constraints that a project breaks."""
    rules = [
        ("title", F.length("title").between(1, 255)), ("description", F.length("description") <= 100),
        ("id", F.rlike("id", F.lit("^c[a-z0-9]{8,}$"))), ("subject_type", F.col("subject_type").isin("real", "fictional")), ("languages", F.col("languages").isNotNull()),
    ]
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules]))


def violations_sql() -> str:
    rules = [("title", "length(title) between 1 and 255"), ("description", "length(description) <= 100"), ("id", "regexp_matches(id, '^c[a-z0-9]{8,}$')"), ("subject_type", "subject_type in ('real', 'fictional')"), ("languages", "languages is not null")]
    return "list_filter([" + ", ".join(f"case when not coalesce({ok}, false) then '{n}' end" for n, ok in rules) + "], lambda x: x is not null)"


def truncated(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


# Segmentation


def normalised(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, WS + "+", " "), r"\.{3,}", "..."))


def normalised_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, '{WS}+', ' ', 'g'), '\\.{{3,}}', '...', 'g'))"


def word_list(c: Column) -> Column:
    return F.filter(F.split(c, WS + "+"), lambda x: x != "")


def word_list_sql(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{WS}+'), lambda x: x <> '')"


def word_count(c: Column) -> Column:
    return F.size(word_list(c))


def boundaries(c: Column) -> Column:
    """0, every offset after a sentence end and its blanks, and the length."""
    pieces = F.regexp_extract_all(c, F.lit(rf"(?s).*?[.!?]+{WS}+"), F.lit(0))
    ends = F.aggregate(pieces, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x))))
    return F.array_distinct(F.concat(ends, F.array(F.length(c))))


def boundaries_sql(c: str) -> str:
    pieces = f"list_transform(regexp_extract_all({c}, '(?s).*?[.!?]+{WS}+'), lambda x: length(x))"
    return f"list_sort(list_distinct(list_concat([0], list_transform(range(1, len({pieces}) + 1), lambda i: cast(list_sum(({pieces})[1:i]) as bigint)), [length({c})])))"


def sentence_pieces(c: Column) -> Column:
    """Text parts and closing marks that are not blank, at least 1 (the marks count as pieces of their own)."""
    parts = F.filter(F.split(c, rf"[.!?]+{WS}+", -1), lambda x: F.regexp_replace(x, WS + "+", "") != "")
    return F.greatest(F.size(parts) + F.regexp_count(c, F.lit(rf"[.!?]+{WS}+")), F.lit(1))


def sentence_pieces_sql(c: str) -> str:
    return f"greatest(len(list_filter(string_split_regex({c}, '[.!?]+{WS}+'), lambda x: regexp_replace(x, '{WS}+', '', 'g') <> '')) + len(regexp_extract_all({c}, '[.!?]+{WS}+')), 1)"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def trimmed_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def citation_sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[.!?]+", -1), trimmed), lambda x: x != "")


def citation_sentences_sql(c: str) -> str:
    return f"list_filter(list_transform(string_split_regex({c}, '[.!?]+'), lambda x: {trimmed_sql('x')}), lambda x: x <> '')"


def citation_tokens(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^A-Za-z0-9_ ]", " "), " +"), lambda x: F.length(x) > 2)


def citation_tokens_sql(c: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower({c}), '[^A-Za-z0-9_ ]', ' ', 'g'), ' +'), lambda x: length(x) > 2)"


def confidence_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), r"[^A-Za-z0-9_ ]", ""), " +"), lambda x: F.length(x) > 2))


def confidence_tokens_sql(c: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(regexp_replace(lower({c}), '[^A-Za-z0-9_ ]', '', 'g'), ' +'), lambda x: length(x) > 2))"


def domain(url: Column) -> Column:
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.coalesce(F.nullif(F.lower(host), F.lit("")), F.lit("unknown"))


def domain_sql(c: str) -> str:
    return f"coalesce(nullif(lower(regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), ''), 'unknown')"


# The short lists of the simple keyword and phrase functions.
SIMPLE_STOP = "this that with have will from they know want been good much some time very when come here just like long make many over such take than them well were".split()
PHRASE_STOP = "the and or but for with by to of in on at as is are was were be been have has had do does did will would could should may might can shall".split()


def simple_keywords(c: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(c), r"[^A-Za-z0-9_ ]", " "), " +")
    return F.slice(F.filter(words, lambda x: (F.length(x) > 3) & (F.length(x) < 15) & ~x.isin(*SIMPLE_STOP)), 1, 10)


def simple_keywords_sql(c: str) -> str:
    stop = ", ".join(f"'{x}'" for x in SIMPLE_STOP)
    return f"list_filter(string_split_regex(regexp_replace(lower({c}), '[^A-Za-z0-9_ ]', ' ', 'g'), ' +'), lambda x: length(x) > 3 and length(x) < 15 and x not in ({stop}))[1:10]"


def simple_phrases(c: Column) -> Column:
    runs = found(F.lower(c), r"\b[a-z]+(?: +[a-z]+){0,2}\b")
    good = lambda p: F.forall(F.split(p, " +"), lambda x: F.length(x) >= 3) & ~p.isin(*PHRASE_STOP)
    return F.slice(F.filter(runs, good), 1, 5)


def simple_phrases_sql(c: str) -> str:
    stop = ", ".join(f"'{x}'" for x in PHRASE_STOP)
    runs = f"regexp_extract_all(lower({c}), '\\b[a-z]+(?: +[a-z]+){{0,2}}\\b')"
    return f"list_filter({runs}, lambda p: len(list_filter(string_split_regex(p, ' +'), lambda x: length(x) < 3)) = 0 and p not in ({stop}))[1:5]"


# Cleaning


def xss_clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[<>]", ""), "(?i)javascript:", ""), r"(?i)on\w+=", ""))


def xss_clean_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace({c}, '[<>]', '', 'g'), '(?i)javascript:', '', 'g'), '(?i)on\\w+=', '', 'g'))"


HTML_BLOCKS = [r"(?is)<script\b.*?</script>", r"(?is)<iframe\b.*?</iframe>", r"(?i)javascript:", r"(?i)on\w+\s*="]


def html_clean(c: Column) -> Column:
    for p in HTML_BLOCKS:
        c = F.regexp_replace(c, js(p), "")
    return c


def html_clean_sql(c: str) -> str:
    for p in HTML_BLOCKS:
        c = f"regexp_replace({c}, {q(p)}, '', 'g')"
    return c
