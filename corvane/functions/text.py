"""Text expressions: all built-in functions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.session import WHITE, squeeze

#: Code points without a visible form; tab, line feed and carriage return are kept.
INVISIBLE = (
    r"[\x{0}-\x{8}\x{B}-\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}\x{AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{206A}-\x{206F}"
    r"\x{FEFF}\x{FFF9}-\x{FFFB}\x{FE00}-\x{FE0F}\x{E0000}-\x{E007F}\x{E0100}-\x{E01EF}]"
)
#: What is taken out of a README, in this order, and what takes its place.
README_RULES = (
    (r"(?s)```.*?```", " "),
    (r"!\[[^\]]*\]\([^)]*\)", " "),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"(?s)<!--.*?-->", " "),
    (r"<[^>]+>", " "),
    (r"(?m)^\s{0,3}#{1,6}\s*", ""),
    (r"[*_`|>~]{1,3}", " "),
    (r"(?m)^ {0,3}[-=]{3,}\s*$", " "),
)
#: Fixed value: signs of style sheets and markup.
MARKUP = r"(?im)@media|@font-face|[{};]\s*$|:\s*\d+px|</?[a-z][^>]*>"
#: Character entities that short HTML fragments use; numeric ones are handled apart.
ENTITIES = (("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&#x2F;", "/"), ("&#47;", "/"), ("&apos;", "'"), ("&nbsp;", " "), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&"))


def text_hash(text: Column) -> Column:
    """sha1 of the text in lower case with white space collapsed and trimmed."""
    return F.sha1(squeeze(text))


def document_hash(title: Column, text: Column) -> Column:
    """Identity of a document: hash of title and body with a blank line between."""
    return text_hash(F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(text, F.lit(""))))


def sanitize(text: Column) -> Column:
    """Without invisible and control characters."""
    return F.regexp_replace(text, INVISIBLE, "")


def is_blank(text: Column) -> Column:
    """Whether nothing visible is left; null counts as blank."""
    return F.coalesce(F.regexp_replace(sanitize(text), WHITE, "") == "", F.lit(True))


def clean_readme(text: Column) -> Column:
    """Markdown to plain text; lossy on purpose."""
    out = sanitize(text)
    for pattern, new in README_RULES:
        out = F.regexp_replace(out, pattern, new)
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(out, f"^{WHITE}|{WHITE}$", "")


def clean_fragment(html: Column) -> Column:
    """The small HTML fragment of a comment or story to plain text: paragraphs become blank lines, tags go, entities are decoded."""
    out = F.regexp_replace(F.regexp_replace(html, r"\x{0}", ""), r"(?i)<p[^>]*>", "\n\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for name, char in ENTITIES:
        out = F.regexp_replace(out, name, char.replace("$", r"\$"))
    lines = F.transform(F.split(out, "\n"), lambda x: F.trim(F.regexp_replace(x, WHITE, " ")))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def clean_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"\x{0}", ""), WHITE, " "))


def compose_repository(name: Column, description: Column, topics: Column, readme: Column, most: int = 100_000) -> Column:
    """Name ("owner / repo"), description, topics and README as one text of bounded length; missing parts are skipped."""
    parts = F.array(
        F.regexp_replace(name, "/", " / "), F.when(description != "", description),
        F.when(F.size(topics) > 0, F.concat(F.lit("Topics: "), F.array_join(topics, ", "))), F.when(readme != "", readme),
    )
    return F.substring(sanitize(F.array_join(parts, "\n\n")), 1, most)


def compose_text(title: Column, text: Column, max_tokens: int = 2048, per_token: int = 4) -> Column:
    """Title and body for an embedder, bounded in characters after sanitising."""
    whole = F.concat_ws("\n\n", F.when(title != "", title), text)
    return F.substring(sanitize(whole), 1, max_tokens * per_token)


def snippet(title: Column, text: Column, size: int = 400) -> Column:
    return F.substring(F.concat_ws("\n\n", F.when(title != "", title), text), 1, size)


def words(text: Column) -> Column:
    """Lower-case words: maximal runs of letters, marks, digits and underscores."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}_]+", " "), " "), lambda w: w != "")


def is_junk(text: Column) -> Column:
    """Too short, mostly markup, or mostly something other than words."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{WHITE}|{WHITE}$", "")
    letters = F.length(F.array_join(F.regexp_extract_all(t, F.lit(r"([A-Za-z][A-Za-z'-]+)"), 1), ""))
    return (F.length(t) < 20) | (F.size(F.regexp_extract_all(t, F.lit(f"({MARKUP})"), 1)) >= 3) | (letters / F.greatest(F.length(t), F.lit(1)) < 0.45)


def framework_of(slug: Column) -> Column:
    """Name of a documentation set without its version (``name~version``)."""
    return F.split_part(slug, F.lit("~"), F.lit(1))


def path_version(path: Column) -> Column:
    """Version in a path such as /docs/v1.2.3/x, or ''."""
    return F.regexp_extract(path, r"(?:^|/)(v\d+(?:\.\w+)+)(?:/|$)", 1)


def text_column(*candidates: Column) -> Column:
    """The body of a stored document whatever its source calls it."""
    return F.coalesce(*candidates)
