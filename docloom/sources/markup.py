"""HTML and XML to text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Named character references that are decoded; the ampersand must come last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def _replace_all(text: Column, rules) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def html_to_text(html: Column) -> Column:
    """Visible text with whitespace collapsed: scripts, styles and comments go, breaks and
    paragraphs separate words, other tags vanish without a trace."""
    bare = _replace_all(
        html,
        [
            (r"(?is)<script[^>]*>.*?</script>", ""),
            (r"(?is)<style[^>]*>.*?</style>", ""),
            (r"(?s)<!--.*?-->", ""),
            (r"(?i)<(br|p)(\s[^>]*)?/?>", " "),
            (r"<[^>]+>", ""),
        ],
    )
    for name, char in ENTITIES:
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def html_to_markdown(html: Column) -> Column:
    """Title and headings as header lines, paragraphs separated by blank lines."""
    return _replace_all(
        html,
        [
            (r"(?is)<script[^>]*>.*?</script>", ""),
            (r"(?is)<style[^>]*>.*?</style>", ""),
            (r"(?s)<!--.*?-->", ""),
            (r"<title>([^<]*)</title>", "\n# $1\n"),
            (r"<h1>", "\n## "),
            (r"</h1>", "\n"),
            (r"(?i)<br\s*/?>", "\n"),
            (r"(?i)<p>", "\n\n"),
            (r"<[^>]+>", ""),
        ],
    )


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    """One row per ``row_tag`` element with whitespace around values removed."""
    reader = spark.read.format("xml").option("rowTag", row_tag).option("ignoreSurroundingSpaces", "true")
    return (reader.schema(schema) if schema else reader).load(path)


def xpath_values(xml: Column, path: str) -> Column:
    """All matches of an XPath expression, whitespace-normalised, empty ones left out."""
    found = F.transform(F.xpath(xml, F.lit(path)), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(found, lambda x: x != "")
