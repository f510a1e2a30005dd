"""Names of a dictionary in texts: one Aho-Corasick automaton over all names, one pass over a text however many there are.

Case does not count, runs of white space are one space, and a name begins and ends at word boundaries where its own end
is a letter or digit. Of matches that overlap, the leftmost counts, of those the longest; or all of them on request.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick

_SPACES = re.compile(r"\s+")
#: White space that is not one space.
_UNEVEN = re.compile(r"\s\s|[^\S ]")


def _plain(text: str) -> tuple[str, list[int] | None]:
    """Lower case with single spaces, and where each character stood (None: where it stands)."""
    low = text.lower()
    if len(low) != len(text):  # letters whose lower case is longer stay as they are
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if not _UNEVEN.search(low):
        return low, None
    out, at, last = [], [], 0
    for m in _SPACES.finditer(low):
        out.append(low[last : m.start()] + " ")
        at.extend(range(last, m.start() + 1))
        last = m.end()
    out.append(low[last:])
    at.extend(range(last, len(low)))
    return "".join(out), at


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


@lru_cache(maxsize=8)
def automaton(names: tuple[str, ...]) -> ahocorasick.Automaton:
    """An automaton whose values are the names' places; of equal names the first; empty ones are left out."""
    auto = ahocorasick.Automaton()
    for i, name in enumerate(names):
        key = _plain(name)[0].strip()
        if key and key not in auto:
            auto.add_word(key, (len(key), i))
    if len(auto):
        auto.make_automaton()
    return auto


def matches(text: str | None, names: tuple[str, ...], overlaps: bool = False) -> list[tuple[int, int, int]]:
    """(start, end, place of the name) of the names in a text, in order."""
    return found_by(automaton(names), text, overlaps)


def found_by(auto: ahocorasick.Automaton, text: str | None, overlaps: bool = False) -> list[tuple[int, int, int]]:
    """matches() by an automaton that is at hand."""
    if not text or not len(auto):
        return []
    plain, at = _plain(text)
    found = []
    for last, (size, i) in auto.iter(plain):
        a, z = last - size + 1, last + 1
        if (a == 0 or not (_word(plain[a]) and _word(plain[a - 1]))) and (z == len(plain) or not (_word(plain[last]) and _word(plain[z]))):
            found.append((a, z, i))
    found.sort(key=lambda m: (m[0], -m[1]))
    if not overlaps:
        found = list(leftmost(found))
    return found if at is None else [(at[a], at[z - 1] + 1, i) for a, z, i in found]


def leftmost(found: Sequence[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Of matches by start and descending end, those that begin where the last one has ended."""
    end = 0
    for m in found:
        if m[0] >= end:
            yield m
            end = m[1]


#: Names as they are written. A name is found by its letters in any case.
CANONICAL = (
    "Netflix|HBO Max|HBO|Disney+|Prime Video|Amazon Prime|Apple TV+|Paramount+|Globoplay|Crunchyroll|Stranger Things|Game of Thrones|House of the Dragon|Star Wars|The Mandalorian|The Witcher|"
    "Breaking Bad|Better Call Saul|The Boys|Marvel|The Last of Us|Squid Game|Black Mirror|Severance|Fallout|Arcane|One Piece|Dragon Ball|Naruto|Attack on Titan|Universal Pictures|Paramount Pictures|"
    "Sony Pictures|A24|Naughty Dog|Bethesda|Nintendo|PlayStation|Xbox"
).split("|")
#: Names that only models' answers are mended by, and only finished bodies.
ANSWER_NAMES = (*CANONICAL, "Max", "DC Comics", "DC", "Suits", "Steam")
BODY_NAMES = (*CANONICAL, "Vought Rising", "Vought", "Soldier Boy", "Billy Butcher", "Homelander", "Starlight")
#: Other spellings.
SPELLINGS = {"disney +": "Disney+", "apple tv +": "Apple TV+", "paramount +": "Paramount+", "warner bro": "Warner Bros.", "warner bros": "Warner Bros.", "warner bro.": "Warner Bros.", "warner bros.": "Warner Bros."}
#: What must follow a name, or must not.
FOLLOWED = {"Max": re.compile(r"\s+(original|serie|exclusiv)", re.I), "DC": re.compile(r"\s+(universe|films?|studi|super)", re.I), "Steam": re.compile(r"\s+(plataforma|jogo|library|deck)", re.I)}
NOT_FOLLOWED = {"Suits": re.compile(r"\s+up", re.I)}


def spelled(text: str | None, names: tuple[str, ...] = ANSWER_NAMES) -> tuple[str | None, list[str]]:
    """The text with all names as they are written, and what was changed, as `found -> written`."""
    if not text:
        return text, []
    keys = (*names, *SPELLINGS)
    written = (*names, *SPELLINGS.values())
    out, fixes, last = [], [], 0
    for a, z, i in matches(text, keys):
        name, own = written[i], text[a:z]
        if own == name or (name in FOLLOWED and not FOLLOWED[name].match(text, z)) or (name in NOT_FOLLOWED and NOT_FOLLOWED[name].match(text, z)):
            continue
        out += [text[last:a], name]
        fixes.append(f"{own} -> {name}")
        last = z
    return "".join([*out, text[last:]]), fixes
