"""Many cues at once: a table of phrases as one pattern that is a trie, so a text is read once however long the table."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def trie_pattern(cues: list[str]) -> str:
    """A regular expression that matches the longest of the cues at a place."""
    root: dict = {}
    for cue in cues:
        node = root
        for letter in cue:
            node = node.setdefault(letter, {})
        node[""] = {}

    def written(node: dict) -> str:
        ways = [("\\" + c if re.match(r"[^\w\s]", c) else c) + written(rest) for c, rest in sorted(node.items()) if c]
        if not ways:
            return ""
        return f"(?:{'|'.join(ways)})" + ("?" if "" in node else "")

    return written(root)


def overlaps_itself(cue: str) -> bool:
    """Whether two occurrences of a cue can overlap, as those of 'ee' or 'employee'."""
    return any(cue.startswith(cue[k:]) for k in range(1, len(cue)))


def longest_cues(text: Column, cues: list[str]) -> Column:
    """The longest cue at each place of a text where any begins."""
    return F.regexp_extract_all(text, F.lit(f"(?=({trie_pattern(cues)}))"), F.lit(1))


def route(text: Column, cues: dict[str, list[str]]) -> Column:
    """The code whose cues a text holds (in any case), `both` if those of several, `general` if none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = F.array_compact(F.array(*[F.when(low.rlike(trie_pattern(words)), F.lit(code)) for code, words in cues.items()]))
    return F.when(F.size(hits) > 1, "both").when(F.size(hits) == 1, hits[0]).otherwise("general")
