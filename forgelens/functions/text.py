"""Text helpers shared by the rule jobs.  All of them are built-in expressions."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as one character class, valid in Java and RE2 alike
WHITESPACE = (
    r"[\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
SUMMARY_LIMIT = 240
ELLIPSIS = "..."
RARE = "zqxjkvbywgfpmh"  # letters that few places of a text hold, rarest first


def ignore_case(pattern: str) -> str:
    """Unicode-aware, case-insensitive form of a bare pattern."""
    return "(?iU)" + pattern


def found(column: Column, pattern: str) -> Column:
    """Case-insensitive pattern search anywhere in a string."""
    return column.rlike(ignore_case(pattern))


def folded(column: Column) -> Column:
    """Lower-case text for term searches.

    Four non-ASCII letters also match an ASCII letter when case is ignored; the mapping of those is skipped for
    text that is all ASCII.
    """
    mapped = F.lower(F.translate(column, "\u0130\u0131\u017f\u212a", "iisk"))
    return F.when(F.length(column) == F.octet_length(column), F.lower(column)).otherwise(mapped)


def pattern_of(terms) -> str:
    """Terms as a bare alternation; ``~`` is an optional separator."""
    return "|".join(term.replace(".", r"\.").replace("~", "[-_ ]?") for term in terms)


def whole_word(terms) -> str:
    """Pattern for any of the terms as a whole word (letters, digits and underscore of any script)."""
    return rf"(?<![\p{{L}}\p{{N}}_])(?:{pattern_of(terms)})(?![\p{{L}}\p{{N}}_])"


def mark(word: str) -> str:
    """The end of a word from its rarest letter on, two characters at least; empty for a word without such a letter."""
    places = [(RARE.index(letter), place) for place, letter in enumerate(word[:-1]) if letter in RARE]
    return word[min(places)[1] :] if places else ""


def marks(column: str, words) -> Column:
    """Marks of the words that a folded text holds, as a short text: of the marks at one place, the longest.

    One pass for all words, which stops at rare letters only.  A text that holds a word holds its mark here, so that words
    without theirs need no search.
    """
    found = sorted({mark(word) for word in words} - {""})
    letters = "".join(sorted({end[0] for end in found}))
    pattern = f"[{letters}](?<=(?=({_any_of(found)})).)"
    return F.expr(f"array_join(regexp_extract_all({column}, {quoted(pattern)}, 1), '\\n')")


def _any_of(words: list[str]) -> str:
    """Pattern of the longest of some words that begins at a place; common beginnings are tried once."""
    ends: dict[str, list[str]] = {}
    for word in words:
        if word:
            ends.setdefault(word[0], []).append(word[1:])
    cases = [re.escape(first) + _any_of(rest) for first, rest in ends.items()]
    if not cases:
        return ""
    return f"(?:{'|'.join(cases)}){'?' if '' in words else ''}"


def _holds(column: str, word: str, marked: str | None) -> str:
    """SQL text: whether a column contains a word; ``marked`` is the column of its marks."""
    end = mark(word) if marked else ""
    exact = f"contains({column}, {quoted(word)})"
    return f"(contains({marked}, {quoted(end)}) AND {exact})" if end else exact


def item_words(terms) -> list[str]:
    """All words that a search for the terms looks for in the items."""
    parts = [part for term in terms if (each := term.replace("~", " ").split())[1:] for part in each]
    return list(dict.fromkeys([word for term in terms for word in spellings(term) if " " not in word] + parts))


def words_found(column: str, words, marked: str | None = None) -> Column:
    """Bit mask of the words that a folded text column holds as whole words, by their place among the sorted ones.

    A plain substring test comes first; the pattern begins with the word, so that it is searched as a literal.
    """
    cases = []
    for place, word in enumerate(sorted(words)):
        exact = word.replace(".", r"\.")
        pattern = rf"{exact}(?<![\p{{L}}\p{{N}}_]{exact})(?![\p{{L}}\p{{N}}_])"
        found = f"{_holds(column, word, marked)} AND {column} RLIKE {quoted(pattern)}"
        cases.append(f"CASE WHEN {found} THEN {1 << place} ELSE 0 END")
    return F.expr(" | ".join(cases))


def spellings(term: str) -> list[str]:
    """Literal spellings of a term."""
    forms = [""]
    for i, part in enumerate(term.split("~")):
        forms = [form + (separator if i else "") + part for form in forms for separator in ("", "-", "_", " ")]
    return list(dict.fromkeys(forms))


def _tests(text: str, terms, items: str | None, marked: str | None) -> list[str]:
    """Per term that no other implies, whether the text holds it.

    A term of several words, or of several spellings, asks for each of its words first: those cannot span items.
    """
    forms = {term: spellings(term) for term in terms}
    words = list(dict.fromkeys(word for found in forms.values() for word in found))
    needed = {word for word in words if not any(other != word and other in word for other in words)}
    tests, seen = [], set()
    for term, found in forms.items():
        own = [word for word in found if word in needed and word not in seen]
        seen.update(own)
        if not own:
            continue
        exact = " OR ".join(
            _holds(text, word, None) if " " in word else _holds(items or text, word, marked) for word in own
        )
        guard = _guard(term, items, marked) if items else None
        tests.append(f"({guard} AND ({exact}))" if guard else exact)
    return tests


def _guard(term: str, items: str, marked: str | None) -> str | None:
    parts = sorted(term.replace("~", " ").split(), key=len, reverse=True)
    return " AND ".join(_holds(items, part, marked) for part in parts) if len(parts) > 1 else None


def may_span(terms, items: str, marked: str | None = None) -> Column:
    """Whether the items hold all words of any term that may span items: without them the text needs no search."""
    spanning = [term for term in dict.fromkeys(terms) if any(" " in word for word in spellings(term))]
    return F.expr(" OR ".join(f"({_guard(term, items, marked)})" for term in spanning))


def mentions(text: str, terms, items: str | None = None, marked: str | None = None) -> Column:
    """Whether a folded text column contains any of the terms.

    Chained substring tests, measured at half the cost of an alternation over all rules together.  Terms that
    contain another term are implied by it and left out.  The text has to be a column, not an expression, so that
    it is folded once per row and not once per term.  ``items`` is a shorter column with every list item of the
    text once; a word without a space cannot span items, so it is looked for there, after its mark in ``marked``.
    """
    return F.expr(" OR ".join(_tests(text, terms, items, marked)))


def quoted(word: str) -> str:
    """SQL string literal."""
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(words) -> Column:
    """Constant string array, parsed in one call."""
    return F.expr(f"array({', '.join(map(quoted, words))})" if words else "cast(array() AS array<string>)")


def folded_items(array: str) -> Column:
    """Elements of a string array as one folded text (no term spans a line break)."""
    return folded(F.array_join(array, "\n"))


def only_matching(array: str, terms, guard: Column) -> Column:
    """Elements that match a term; rows whose ``guard`` fails skip the element-wise pass."""
    pattern = ignore_case(pattern_of(terms))
    return F.when(guard, F.filter(array, lambda item: item.rlike(pattern))).otherwise(strings(()))


def normalized_action(action: Column) -> Column:
    """Action name without its pinned version."""
    return F.substring_index(action, "@", 1)


def owner_of(repo: Column) -> Column:
    return F.substring_index(repo, "/", 1)


def repo_url(repo: Column) -> Column:
    return F.concat(F.lit("https://github.com/"), repo)


def action_url(action: Column) -> Column:
    """Repository page of an action: its first two path parts, or empty for a bare name."""
    return F.when(F.contains(action, F.lit("/")), repo_url(F.substring_index(action, "/", 2))).otherwise(F.lit(""))


def short_summary(text: Column) -> Column:
    """One-line summary: white space collapsed, long text cut to fit the limit with an ellipsis."""
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE + "+", " "))
    keep = SUMMARY_LIMIT - len(ELLIPSIS)
    cut = F.concat(F.rtrim(F.substring(line, 1, keep)), F.lit(ELLIPSIS))
    return F.when(F.length(line) <= SUMMARY_LIMIT, line).otherwise(cut)
