"""Dictionary matching and the entity layer against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import names
from quillspark.operators import entities

LETTERS = "abc X.+é\n"


def plain_matches(text, given, overlaps):
    """All names at all places by a regular expression each."""
    found = []
    for i, name in enumerate(given):
        key = " ".join(name.lower().split(" ")).strip()
        key = re.sub(r"\s+", " ", key)
        if not key or any(re.sub(r"\s+", " ", x.lower()).strip() == key for x in given[:i]):
            continue
        pattern = re.escape(key).replace(r"\ ", r"\s+")
        for m in re.finditer(f"(?={pattern})", text.lower()):
            end = re.compile(pattern).match(text.lower(), m.start()).end()
            a, z = m.start(), end
            word = lambda c: c.isalnum() or c == "_"
            if (a and word(text[a]) and word(text[a - 1])) or (z < len(text) and word(text[z - 1]) and word(text[z])):
                continue
            found.append((a, z, i))
    found.sort(key=lambda m: (m[0], -m[1]))
    return found if overlaps else list(names.leftmost(found))


@pytest.mark.parametrize("overlaps", [False, True])
def test_matches_equal_an_expression_for_each_name(overlaps):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    for _ in range(400):
        given = tuple(word(rng.randint(1, 5)) for _ in range(rng.randint(1, 8)))
        text = word(rng.randint(0, 60))
        assert names.matches(text, given, overlaps) == plain_matches(text, given, overlaps), (text, given)


def test_odd_texts():
    assert names.matches(None, ("a",)) == [] and names.matches("", ("a",)) == [] and names.matches("a", ()) == [] and names.matches("a", ("", "  ")) == []
    assert names.matches("İstanbul HBO", ("hbo",)) == [(9, 12, 0)]
    assert names.matches("x  \n y", ("x y",)) == [(0, 6, 0)]
    assert len(names.matches("ab " * 200_000, ("ab", "ab ab"))) == 100_000


def test_spelling_is_idempotent():
    given = "netflix, HBO   max e hbo; DISNEY + e Warner Bros. e warner bros, dc comics, dc films, dc, max exclusivo, o max, suits up, SUITS, steam deck, steam"
    fixed, fixes = names.spelled(given)
    assert fixed == "Netflix, HBO Max e HBO; Disney+ e Warner Bros. e Warner Bros., DC Comics, DC films, dc, Max exclusivo, o max, suits up, Suits, Steam deck, steam"
    assert fixes[:2] == ["netflix -> Netflix", "HBO   max -> HBO Max"] and names.spelled(fixed) == (fixed, [])
    assert names.spelled("vought rising e homelander", names.BODY_NAMES)[0] == "Vought Rising e Homelander"
    assert names.spelled(None) == (None, []) and names.spelled("") == ("", [])


def test_a_dictionary_in_blocks_finds_the_same(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 3)))
    given = list({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(80)})
    rows = [(i % 7, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(None, None), (1, ""), (2, "a b"), (2, "a b")]
    texts = spark.createDataFrame([(*r, 1, 2) for r in rows], "id long, text string, row int, start int")
    dictionary = spark.createDataFrame([(n,) for n in given] + [(None,), ("",)], "name string")
    for overlaps in (False, True):
        want = sorted((i, a, z, given[k]) for i, t in rows for a, z, k in plain_matches(t or "", given, overlaps))
        for size in (10**9, 300):
            got = sorted(tuple(r) for r in entities.occurrences(texts, dictionary, "id", overlaps=overlaps, block_bytes=size).collect())
            assert got == want, (overlaps, size)
    assert entities.occurrences(texts, dictionary.limit(0), "id").count() == 0 and entities.occurrences(texts.limit(0), dictionary, "id").count() == 0


def test_names_of_a_source(spark):
    text = "O ator Pedro Pascal e Bella Ramsey estão em The Last of Us, da HBO MAX. Em 2025, PEDRO PASCAL volta. Nova York; A Marvel's Studios. Os dois. Warner bros. fez X."
    got = {r.key: r.name for r in entities.canonical_entities(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string"), "id").collect()}
    assert got["2025"] == "2025" and got["pedro pascal e bella ramsey"] == "Pedro Pascal e Bella Ramsey" and got["pedro pascal"] == "Pedro Pascal" and got["bella ramsey"] == "Bella Ramsey"
    assert got["the last of us"] == "The Last of Us" and got["hbo max"] == "HBO MAX" and "os" not in got and "nova york" not in got and "x" not in got


def test_corrections_guard_and_apply(spark):
    sources = spark.createDataFrame([(1, "viu Pedro Pascal, Marvel Studios e Ana $oares Lima, Tom Holland's."), (2, "Nada")], "id long, text string")
    texts = spark.createDataFrame([(1, "viu Pedro Pascall, Pedro Pascalls; Marvl Studios, com Pedra Pascal. viu Tom Holland.", "x"), (2, "viu Pedro Pascall", "y"), (3, None, "z"), (1, "viu Pedro Pascall", "w")], "id long, text string, other string")
    fixes = entities.corrections(texts, sources, "id")
    got = {(r.found, r.name, r.action, r.reason) for r in fixes.collect()}
    assert {("Pedro Pascall", "Pedro Pascal", "FIX", None), ("Marvl Studios", "Marvel Studios", "FIX", None), ("Pedra Pascal", "Pedro Pascal", "WARN", "first_name_diff"), ("Tom Holland", "Tom Holland's", "WARN", "english_possessive_only")} <= got
    out = sorted((r.id, r.text or "", r.other) for r in entities.corrected(texts, fixes, "id").collect())
    assert out == [(1, "viu Pedro Pascal", "w"), (1, "viu Pedro Pascal, Pedro Pascal; Marvel Studios, com Pedra Pascal. viu Tom Holland.", "x"), (2, "viu Pedro Pascall", "y"), (3, "", "z")]


def test_a_long_run_of_capitals_is_one_name(spark):
    given = [(1, "vi " + "Ouat " * 50_000 + "de Rio, e Sol"), (2, "vi A " + "de da " * 50_000 + "Rio Bom")]
    got = {r.id: r.names for r in spark.createDataFrame(given, "id long, text string").select("id", entities.capitalised(F.col("text")).alias("names")).collect()}
    assert got == {1: ["Ouat " * 50_000 + "de Rio"], 2: ["A " + "de da " * 50_000 + "Rio Bom"]}


def test_a_studio_inside_a_word_is_none(spark):
    given = [(1, "a key AKIAS3V7MAXP2 here"), (2, "na Max, agora; a Disney+ e a Warner Bros. de novo")]
    got = {(r.id, r.key) for r in entities.canonical_entities(spark.createDataFrame(given, "id long, text string"), "id").collect()}
    assert {k for i, k in got if i == 1} == {"akias3v7maxp2"} and {"max", "disney+", "warner bros."} <= {k for i, k in got if i == 2}
