"""Quality rules against plain counting."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from tidefold.llm import quality as q

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORDS.findall(text)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    lines, seen, dups = text.split("\n"), set(), 0
    for line in lines:
        if WORDS.search(line):
            dups += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered), failed


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "é#", "|", " ", "\x0b", "\n", "\x85", "\x1c", "　", "😀", "a.\n"]), max_size=120).map(lambda x: "".join(x[:60]) + " ".join(x[60:])))
def test_base_figures(text):
    assert tuple(q.measure(text)[:6]) == plain(text)


def test_lines():
    assert q.line_fails("Home | About us | Contact | Blog") == "navigation"
    assert q.line_fails("THIS!! IS!! GREAT!! BUY!! NOW!!") == "punctuation"
    assert q.line_fails("word### other%%% third&&& fourth***") == "punctuation"
    assert q.line_fails("All rights reserved.") == "boilerplate"
    assert q.line_fails("Contact form") == "punctuation"
    for line in ("» Read more", "Alle Rechte vorbehalten.", "© 2020 Tous droits réservés.", "Lea nuestra política de privacidad.", "Sign in"):
        assert q.line_fails(line) == "boilerplate", line
    for fine in ("Her design in oak won a prize.", "The blog in question is closed now.", "He will read more books this year.", "They read more.", "Das war die Anmeldung."):
        assert q.line_fails(fine) == "", fine
    for fine in ("A plain sentence, as it should be.", "Die.", "", "   ", "A line that goes on without any end", "She said: \"Yes\"", "Costs are 5% lower (see p. 3).", "Wait... what?"):
        assert q.line_fails(fine) == "", fine


def test_documents(spark):
    rng = random.Random(1)
    prose = "\n".join(" ".join(rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(15)) + "." for _ in range(8))
    junk = "\n".join(" ".join(f"w{rng.randrange(900)}$$$" for _ in range(15)) for _ in range(8))
    texts = {1: prose, 2: junk, 3: prose + "\nHome | About | Contact | Login", 4: None, 5: "", 6: "short text.", 7: "same words again. " * 40, 8: "\n".join([prose, junk, junk.replace("w", "v").replace("$", "#")]), 9: prose * 3000}
    df = spark.createDataFrame([(k, t, True, "n") for k, t in texts.items()] + [(1, prose, True, "n"), (None, prose, None, None)], "doc_id long, text string, kept boolean, cleaned string")
    got = {r.doc_id: r for r in q.report(df).collect()}
    assert {k for k, r in got.items() if r.kept} == {1, 3, None}
    assert {k for k, r in got.items() if r.base_failed} == {4, 5, 6, 7, 9}
    for k, t in texts.items():
        if k != 9:
            assert tuple(got[k][1:7]) == plain(t)
    kept = q.clean(df)
    rows = kept.collect()
    assert kept.columns == df.columns and sorted((r.doc_id or -1) for r in rows) == [-1, 1, 1, 3]
    assert next(r for r in rows if r.doc_id == 3).text == prose
    assert q.report(df.limit(0)).count() == q.clean(df.limit(0)).count() == 0
