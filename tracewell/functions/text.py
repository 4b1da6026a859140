"""Text kernel: column expressions for tokens, identifiers, paths and labels."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The combining marks that the index drops, so that they never part a word (U+0300 to U+0331).
DROPPED_MARKS = [*range(0x300, 0x305), *range(0x306, 0x30D), 0x30F, 0x311, 0x31B, *range(0x323, 0x329), 0x32D, 0x32E, 0x330, 0x331]


def _folded(char: str) -> str:
    """What the index makes of a character: its case folded where that is one character, and a Latin letter with one mark without it."""
    plain = next((c for c in (char.casefold(), char.lower()) if len(c) == 1), char.lower())
    parts = unicodedata.normalize("NFD", plain)
    return parts[0] if len(parts) == 2 and "a" <= parts[0] <= "z" and unicodedata.combining(parts[1]) else plain[:1]


#: Characters that folding changes, and what they become, from Unicode's own tables; those dropped come last.
_CHANGED = {c: _folded(c) for c in map(chr, (*range(0x41, 0xD800), *range(0xF900, 0x1F000))) if unicodedata.category(c)[0] in "LN" and _folded(c) != c}
FOLD_FROM = "".join([*_CHANGED, *map(chr, DROPPED_MARKS)])
FOLD_TO = "".join(_CHANGED.values())
#: What words are made of, as a set of a regular expression.
WORD = r"[\p{L}\p{N}\p{Co}]+"

#: Fixed values of the vocabulary rules, as the rules list them: words that a neighbourhood never proposes.
STOPWORDS = (
    "the", "and", "for", "that", "this", "with", "from", "was", "were", "are", "but", "not", "all", "any", "can", "has", "had", "have", "its", "our",
    "out", "than", "then", "they", "them", "there", "these", "those", "what", "when", "which", "will", "would", "you", "your", "into", "over", "only",
    "one", "two", "how", "why", "who", "his", "her", "their", "been", "because", "should", "could", "does", "did", "each", "more", "most", "some",
    "such", "very",
)

#: Language tags by file extension.
LANGUAGES = {
    "rust": ("rs",), "markdown": ("md", "markdown"), "sql": ("sql",), "toml": ("toml",), "yaml": ("yml", "yaml"), "json": ("json",), "shell": ("sh", "bash"),
    "javascript": ("js", "mjs", "cjs"), "typescript": ("ts",), "typescriptreact": ("tsx",), "javascriptreact": ("jsx",), "python": ("py",), "html": ("html",), "css": ("css",),
}

#: Layers by what follows a path's last dot.
LAYERS = {
    "code": ("rs", "py", "ts", "tsx", "js", "jsx", "mjs", "cjs", "go", "c", "cc", "cpp", "h", "hpp", "java", "rb", "kt", "swift", "scala", "sh", "bash"),
    "config": ("toml", "yaml", "yml", "json", "sql", "lock", "cfg", "ini"),
    "design": ("md", "markdown", "txt", "rst", "adoc"),
}


def fold(text: Column) -> Column:
    """Folded case, without the marks of Latin letters; a text of ASCII alone (as many bytes as characters) is only lower-cased."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, FOLD_FROM, FOLD_TO))


def tokens(text: Column) -> Column:
    """The index's tokens: runs of letters, digits and private characters of the folded text."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits, diacritics kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def is_candidate(term: Column) -> Column:
    """Whether a neighbourhood may propose the term: three characters or more, no number, no stop word."""
    return (F.length(term) >= 3) & ~term.rlike(r"^\p{N}+$") & ~term.isin(*STOPWORDS)


def is_indexable(term: Column) -> Column:
    """Three characters or more and none that a regular expression gives a meaning."""
    return (F.length(term) >= 3) & ~term.rlike(r"[\\.+*?()|\[\]{}^$]")


def split_identifier(token: Column) -> Column:
    """Lower-cased parts of an identifier, cut at camel humps, after acronyms, and between letters and digits."""
    cut = F.regexp_replace(token, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{L})(?=[0-9])|(?<=[0-9])(?=\p{L})", "\u0001")
    return F.transform(F.filter(F.split(cut, "\u0001"), lambda p: p != ""), F.lower)


def expand_identifiers(text: Column) -> Column:
    """The text's words in lower case, each followed by its parts where it has several."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    both = lambda w: F.concat(F.array(F.lower(w)), F.filter(split_identifier(w), lambda p: p != F.lower(w)))
    return F.array_join(F.flatten(F.transform(words, both)), " ")


def summarize(text: Column, n: int = 200) -> Column:
    """At most n characters, cut at the last white space if that lies in the second half (counted in bytes), and an ellipsis."""
    head = F.substring(text, 1, n)
    at_space = F.regexp_extract(head, r"(?s)^(.*)\s", 1)
    cut = F.when(head.rlike(r"\s") & (F.octet_length(at_space) > n // 2), at_space).otherwise(head)
    return F.when(F.length(text) <= n, text).otherwise(F.concat(cut, F.lit("…")))


def truncate_bytes(text: Column, n: int = 500) -> Column:
    """At most n bytes of UTF-8, no character broken, and an ellipsis where text was cut."""
    raw = F.trim(text).cast("binary")
    pieces = [F.try_validate_utf8(F.substring(raw, 1, n - k).cast("string")) for k in range(4)]
    return F.when(F.octet_length(raw) <= n, F.trim(text)).otherwise(F.concat(F.coalesce(*pieces), F.lit("…")))


def lines(text: Column) -> Column:
    """Lines without their ends; no empty line after a final line feed."""
    parts = F.split(F.regexp_replace(text, r"\n\z", ""), "\n")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(parts, lambda p: F.regexp_replace(p, r"\r\z", "")))


def line_of(text: Column, needle: Column, first_line: Column) -> Column:
    """The number of the line of text in which needle is first found, counted from first_line; that one if it isn't found."""
    at = F.instr(text, needle)
    head = F.substring(text, F.lit(1), F.greatest(at - 1, F.lit(0)))
    return first_line + F.when(at > 0, F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))).otherwise(0)


def contains_like(text: Column, needle: str) -> Column:
    """A substring test that, as LIKE does, ignores the case of ASCII letters."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(text, upper, lower).contains(needle.translate(str.maketrans(upper, lower)))


def short_hash(digest: Column) -> Column:
    return F.substring(digest, 1, 7)


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """What follows the last dot of a path's last component, empty without one."""
    return F.regexp_extract(base_name(path), r"[^.]\.([^.]+)$", 1)


def author_language(path: Column) -> Column:
    """What follows a path's last dot, in lower case; "?" without a dot."""
    return F.when(path.contains("."), F.lower(F.substring_index(path, ".", -1))).otherwise("?")


def language_of(path: Column) -> Column:
    """The language tag of a file, null where its extension isn't known."""
    ext, found = extension(path), F.lit(None).cast("string")
    for language, names in LANGUAGES.items():
        found = F.when(ext.isin(*names), language).otherwise(found)
    return found


def under(path: Column, root: Column) -> Column:
    """Whether path is root or lies below it, by whole components."""
    return (path == root) | path.startswith(F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))


def relative_to(path: Column, root: Column) -> Column:
    """path below root, or path as it is where it isn't below."""
    prefix = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(path.startswith(prefix), F.substring(path, F.length(prefix) + 1, F.length(path))).otherwise(path)


def normalize_path(path: Column) -> Column:
    """A path without "." and ".." components; null where it would leave its root."""
    step = lambda acc, part: F.when(acc.isNull(), acc).when(part.isin("", "."), acc).when((part == "..") & (F.size(acc) == 0), F.lit(None)).when(part == "..", F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(part)))
    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def path_prefixes(path: Column) -> Column:
    """Every ancestor of a path, itself included, by whole components."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def slug(path: Column) -> Column:
    return F.translate(path, "/_.", "---")


def is_safe_key(key: Column) -> Column:
    return key.rlike(r"^[a-z0-9_.]{1,64}$")


def owned_by_other_corpus(path: Column) -> Column:
    """Files that belong to the session notes or the documents rather than to source code."""
    markdown = extension(path).isin("md", "markdown")
    return (base_name(path) == "CLAUDE.md") | (markdown & (path.startswith("docs/") | ~path.contains("/")))


def layer_of(path: Column) -> Column:
    """code, config, design, session, memory or other."""
    last = F.substring_index(path, ".", -1)
    found = F.lit("other")
    for layer, names in LAYERS.items():
        found = F.when(last.isin(*names), layer).otherwise(found)
    return F.when(base_name(path) == "CLAUDE.md", "session").when((base_name(path) == "MEMORY.md") | path.contains("/memory/"), "memory").otherwise(found)


def split_qualified(name: Column) -> tuple[Column, Column]:
    """(schema or null, object) of a dotted name, quotes and brackets taken off."""
    parts = F.transform(F.split(name, r"\."), lambda p: F.regexp_replace(p, r"""^[\["'`]+|[\]"'`]+$""", ""))
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)), F.element_at(parts, -1)


def split_message(message: Column) -> tuple[Column, Column]:
    """(summary, body or null) of a commit message."""
    summary = F.trim(F.split(message, "\n", 2)[0])
    body = F.regexp_replace(F.regexp_extract(message, r"(?s)\A[^\n]*\n(.*)\z", 1), r"\A\n+|\s+\z", "")
    return summary, F.nullif(body, F.lit(""))


def json_strings(text: Column) -> Column:
    """A JSON array of strings; null for none, the text itself as one element where it isn't one."""
    return F.when(text.isNull() | (text == ""), F.lit(None)).otherwise(F.coalesce(F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>")), F.array(text)))
