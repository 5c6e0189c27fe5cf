"""Text of changes and comments. Patterns use (?U) so that word characters and digits are those of Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a bug fix looks like, in lower-case text.
BUG_NUMBERS = [r"bug[#\s]*[0-9]+", r"pr[#\s]*[0-9]+", r"show_bug\.cgi\?id=[0-9]+", r"\[[0-9]+\]"]
BUG_WORDS = r"\b(fix(e(d|s))?|bugs?|defects?|patch)\b"
NUMBERS_ONLY = r"[\d\s.,;:#\[\]/\\-]+"

# Phrases of refactoring changes; a blank stands for any white space.
REFACTORING = [
    "refactor(ing|ed)?", "mov(e|ed|ing)", "split(ting)?", "fix(e(d|s)|ing)?", "introduc(e|ed|ing)", "decompos(e|ed|ing|ition)", "reorgani(z|s)(e|ed|ing|ation)?",
    "extract(ed|ing)?", "merg(e|ed|ing)", "renam(e|ed|ing)", "chang(e|ed|ing)", "restructur(e|ed|ing)", "reformat(ted|ting)?", "extend(ed|ing)?", "remov(e|ed|ing)",
    "replac(e|ed|ing)", "rewrit(e|ing)", "simplify(ing|ied)?", "creat(e|ed|ing)", "improv(e|ed|ing|ement)", "add(ed|ing)?", "modify(ied|ing)?", "enhanc(e|ed|ing)",
    "rework(ed|ing)?", "inlin(e|ed|ing)", "redesign(ed|ing)?", "cleanup", "reduc(e|ed|ing)", "encapsulat(e|ed|ing|ion)", "removed poor coding practice",
    "improve naming consistency", "removing unused classes", "pull some code up", "use better name", "replace it with", "make maintenance easier", "code cleanup",
    "minor simplification", "reorganize project structures", "code maintenance for refactoring", "remove redundant code", "moved and gave clearer names to",
    "refactor bad designed code", "getting code out of", "deleting a lot of old stuff", "code revision", "fix technical debt", "fix quality issue",
    "antipattern bad for performances", "major structural changes", "minor structural changes", "clean up unnecessary code", "code reformatting & reordering", "nicer code",
    "formatted", "structure", "simplify code redundancies", "added more checks for quality factors", "naming improvements", "renamed for consistency",
    "refactoring towards nicer name analysis", "change design", "modularize the code", "code cosmetics", "moved more code out of", "remove dependency", "enhanced code beauty",
    "simplify internal design", "change package structure", "use a safer method", "code improvements", "minor enhancement", "get rid of unused code", "fixing naming convention",
    "fix module structure", "code optimization", "fix a design flaw", "nonfunctional code cleanup", "improve code quality", "fix code smell", "use less code",
    "avoid future confusion", "more easily extended", "polishing code", "move unused file away", "many cosmetic changes", "inlined unnecessary classes", "code cleansing",
    "fix quality flaws", "simplify the code",
]

# What is stripped from comments, in this order.
LINKS = r"https?://[^\s<>\"]+|www\.[^\s<>\"]+|[^\s<>\"]+\.[a-zA-Z]{2,}"
PATCH_SET = r"patch set \d+:"
INLINE = r"\(\d+\s*(?:inline\s+)?comments?\)"
SYMBOLS = r"[^a-zA-Z'0-9+-]+"
PROJECTS = r"\b(nova|neutron|cinder|horizon|keystone|swift|glance|openstack|ci)\b"

# Languages by file extension.
LANGUAGES = {"ts": "JavaScript", "js": "JavaScript", "py": "Python", "java": "Java", "c": "CPP", "php": "PHP", "dart": "Dart", "r": "R"}


def _text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _links() -> str:
    """LINKS for Java: what only ends like a host is looked for where a run of letters begins, as it begins there wherever it is found; so a run is read once, not from each of its letters on."""
    first, second, third = LINKS.split("|")
    return rf"{first}|{second}|(?<![^\s<>\"]){third}"


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def bug_fix_confidence(subject: str | Column, message: str | Column) -> Column:
    """0 to 2: one for a bug number, one for a bug word, one for a text of numbers and marks only; at most 2."""
    own = [stripped(_text(subject)), stripped(_text(message))]
    low = F.lower(F.concat_ws(" ", *(F.nullif(x, F.lit("")) for x in own)))
    number = low.rlike("(?U)" + "|".join(BUG_NUMBERS))
    word = low.rlike("(?U)" + BUG_WORDS)
    digits = own[0].rlike(rf"(?U)^{NUMBERS_ONLY}\z") | own[1].rlike(rf"(?U)^{NUMBERS_ONLY}\z")
    return F.least(F.lit(2), number.cast("int") + word.cast("int") + digits.cast("int"))


def refactoring_confidence(subject: str | Column, message: str | Column) -> Column:
    """1 if the subject or message holds a refactoring phrase as whole words, else 0."""
    pattern = "|".join(p.replace(" ", r"\s+") for p in REFACTORING)
    return F.concat(_text(subject), F.lit(" "), _text(message)).rlike(rf"(?iU)\b({pattern})\b").cast("int")


def mentions_test(subject: str | Column, message: str | Column) -> Column:
    """1 if the subject or message contains "test" (so "latest" counts)."""
    return (F.lower(_text(subject)).contains("test") | F.lower(_text(message)).contains("test")).cast("int")


def alternation(labels: list[str]) -> str:
    """Labels as whole words, longest first, taken literally. Without labels it matches every word border."""
    longest = sorted(labels, key=lambda x: -len(x))
    return r"\b(?:" + "|".join("".join("\\" + c if not c.isalnum() and c != "_" else c for c in x) for x in longest) + r")\b"


def clean_comment(c: str | Column, labels: list[str] | None = None) -> Column:
    """Lower case; links, patch-set headers, inline-comment counts, labels, symbols and project names become blanks; words joined by one blank.

    labels: those to strip (all for mining, those outside Code-Review for matching); None strips none.
    """
    out = F.lower(_text(c))
    for pattern in (_links(), PATCH_SET, INLINE):
        out = F.regexp_replace(out, "(?U)" + pattern, " ")
    if labels is not None:
        # First letters are looked at before word borders, which take longer.
        begin = "(?=" + "|".join(sorted({"\\" + x[0] if not x[0].isalnum() and x[0] != "_" else x[0] for x in labels})) + ")" if labels and all(labels) else ""
        out = F.regexp_replace(out, "(?iU)" + begin + alternation(labels), " ")
    out = F.regexp_replace(out, SYMBOLS, " ")
    out = F.regexp_replace(out, "(?U)(?=[cghknos])" + PROJECTS, " ")
    return F.trim(F.regexp_replace(out, " +", " "))


def bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ngrams(words: Column, least: int = 1, most: int = 10) -> Column:
    """All runs of least to most consecutive words, joined by a blank."""

    def runs(w: Column) -> Column:
        sizes = F.sequence(F.lit(least), F.least(F.lit(most), F.size(w)))
        made = F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " ")))
        return F.when(F.size(w) >= least, F.flatten(made)).otherwise(F.array().cast("array<string>"))

    return bound(words, runs)


def word_list(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def flag(c: str | Column) -> Column:
    """Whether a hand-set flag is 1 (or 1.0)."""
    return F.coalesce(F.trim((F.col(c) if isinstance(c, str) else c).cast("string")).isin("1", "1.0"), F.lit(False))


def holds_keyword(cleaned: Column, keywords: list[str], labels: list[str]) -> Column:
    """Whether a cleaned comment contains a keyword as a substring, or a label as a whole word."""
    literal = lambda x: "".join("\\" + c if not c.isalnum() and c != "_" else c for c in x)
    parts = [literal(k) for k in keywords] + [rf"\b{literal(x)}\b" for x in labels]
    return cleaned.rlike("(?U)" + "|".join(parts)) if parts else F.lit(False)


def comment_class(request: Column, confirmation: Column) -> Column:
    return F.when(request, "request").when(confirmation, "confirmation").otherwise("other")


def urgency(cleaned: Column, keywords: list[str]) -> Column:
    """Share of five that the keywords found make, 1 at most."""
    hits = sum((cleaned.contains(k).cast("int") for k in keywords), F.lit(0))
    return F.least(hits / F.lit(5.0), F.lit(1.0))


def language_of(path: str | Column) -> Column:
    """The language of a file by its extension; null if unknown."""
    c = F.col(path) if isinstance(path, str) else path
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.try_element_at(table, F.regexp_extract(c, r"[^/]\.([^./]*)$", 1))


def change_text(revisions: Column, current: Column, message: Column) -> Column:
    """The message; else the current revision's commit message, else that of the revision with the highest number."""
    last = F.element_at(F.array_sort(F.transform(F.filter(F.map_entries(revisions), lambda e: e["value"]["commit"]["message"].isNotNull()), lambda e: F.struct(e["value"]["_number"].alias("n"), e["value"]["commit"]["message"].alias("m")))), -1)["m"]
    return F.coalesce(F.nullif(message, F.lit("")), F.nullif(revisions[current]["commit"]["message"], F.lit("")), F.when(F.size(revisions) > 0, last), F.lit(""))


def owner_email(owner: Column, revisions: Column) -> Column:
    """The owner's address; else that of the author of the first revision (by number) that has one; else empty."""
    named = F.array_sort(F.transform(F.filter(F.map_values(revisions), lambda r: F.coalesce(r["commit"]["author"]["email"], F.lit("")) != ""), lambda r: F.struct(r["_number"].alias("n"), r["commit"]["author"]["email"].alias("e"))))
    return F.coalesce(F.nullif(owner["email"], F.lit("")), F.when(F.size(named) > 0, F.try_element_at(named, F.lit(1))["e"]), F.lit(""))


def change_file_key(change_number: Column) -> Column:
    return F.concat(F.lit("change_"), change_number.cast("string"))


def commit_file_key(change_number: Column, revision_id: Column) -> Column:
    return F.concat(F.lit("commit_"), change_number.cast("string"), F.lit("_"), F.substring(revision_id, 1, 8))
