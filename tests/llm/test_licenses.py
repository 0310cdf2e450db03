import random
import textwrap

import pytest
from llm.conftest import EDGES, prose

from tallyforge.llm.licenses import RULES, SENTENCES, Sentences, match_rules, normalise, scan_licenses, sentences

TEXTS = {name: text for name, text in SENTENCES}
MIT = "The MIT License\n\nCopyright (c) 2020 Someone\n\n" + ". ".join(TEXTS[k] for k in ("MIT_GRANT", "MIT_KEEP", "MIT_AS_IS")) + "."
BSD = ". ".join(TEXTS[k] for k in ("BSD_REDISTRIBUTE", "BSD_SOURCE", "BSD_BINARY")) + ". " + TEXTS["BSD_ENDORSE"].replace("<holder>", "the Example Foundation") + "."
APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\");\n" + TEXTS["APACHE2_YOU_MAY"]


def found(messy, texts):
    return sorted((r.doc_id, r.license, r.start, r.stop) for r in scan_licenses(messy(texts)).collect())


def test_full_texts_and_notices(messy):
    rnd = random.Random(1)
    texts = [MIT, BSD, prose(rnd, 50) + ".\nReleased under the MIT License.\n" + prose(rnd, 9), "RELEASED   UNDER the mit license!", "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.", "This is not a license."]
    got = [(r.doc_id, r.license, len(r.sentence_ids)) for r in sorted(scan_licenses(messy(texts)).collect(), key=lambda r: (r.doc_id, r.start))]
    assert got == [(0, "MIT", 4), (1, "BSD-3-Clause", 4), (2, "MIT", 1), (3, "MIT", 1), (4, "CC-BY-NC-4.0", 1), (4, "Apache-2.0", 1)]


def test_spans_hold_the_evidence(messy):
    text = "\U0001f600 intro. Released under the MIT License. rest " * 2
    got = found(messy, [text])
    assert [normalise(text[a:b]) for _, _, a, b in got] == ["released under the mit license"] * 2


def test_edges_repeats_and_empty_table(messy):
    assert found(messy, EDGES) == []
    line = "Released under the MIT License."
    rows = scan_licenses(messy([line, line, None, "x " * 200_000 + ". " + line], [None, 4, 4, 5])).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["4", "5", "None"]
    assert scan_licenses(messy([line]).limit(0)).count() == 0


def test_rules_are_tried_in_order():
    rules = (("long", ("A", "B")), ("short", ("A",)), ("b", ("B",)))
    assert list(match_rules([(0, "A"), (1, "B")], rules, 0)) == [("long", 0, 1)]
    assert list(match_rules([(0, "A"), (3, "B")], rules, 2)) == [("long", 0, 1)]
    assert list(match_rules([(0, "A"), (4, "B")], rules, 2)) == [("short", 0, 0), ("b", 1, 1)]
    assert list(match_rules([(0, "B"), (1, "C")], rules, 2)) == [("b", 0, 0), ("unmatched", 1, 1)]


@pytest.mark.parametrize("seed", range(5))
def test_against_plain_lookup(messy, seed):
    """Every notice of one sentence, put into prose, is found where it stands, and nothing else is."""
    rnd = random.Random(seed)
    single = {names[0]: license for license, names in RULES if len(names) == 1}
    texts, wanted = [], []
    for k in range(30):
        name, sentence = rnd.choice([(n, s) for n, s in SENTENCES if n in single and len(list(sentences(s))) == 1 and "<" not in s])
        before = prose(rnd, rnd.randint(0, 30))
        texts.append(f"{before}.\n{sentence}.\n{prose(rnd, 5)}")
        wanted.append((k, single[name]))
    assert [x[:2] for x in found(messy, texts)] == wanted


def test_templates():
    known = Sentences((("X", "Copyright <year> by <holder>"),))
    assert known.identify([normalise("Copyright 2020 by The Example Project"), "copyright by"]) == ["X", None]


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// ", "dnl ", ";; "])
def test_wrapped_texts_of_every_rule(messy, mark):
    """Hard-wrapped sentences, as in licence files and comments, give the licence as unwrapped ones do."""
    texts = []
    for _, names in RULES:
        whole = ". ".join(TEXTS[n].replace("<holder>", "the Example Foundation") for n in names) + "."
        texts.append("\n".join(f"{mark}{line}" for line in textwrap.wrap(whole, 40)) + "\n\n" + prose(random.Random(1), 20))
    got = sorted((r.doc_id, r.license, len(r.sentence_ids)) for r in scan_licenses(messy(texts)).collect())
    assert got == [(k, license, len(names)) for k, (license, names) in enumerate(RULES)]


def test_real_headers(messy):
    apache = APACHE + """.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language."""
    commented = "/*\n" + "\n".join(f" * {line}".rstrip() for line in apache.split("\n")) + "\n */\nint x;"
    lists = "1) " + TEXTS["BSD_SOURCE"] + ".\nReleased under the MIT License\nby someone"
    got = [(r.doc_id, r.license, len(r.sentence_ids)) for r in sorted(scan_licenses(messy([APACHE, apache, commented, lists])).collect(), key=lambda r: (r.doc_id, r.start))]
    assert got == [(0, "Apache-2.0", 1), (0, "unmatched", 1), (1, "Apache-2.0", 4), (2, "Apache-2.0", 4), (3, "unmatched", 1), (3, "MIT", 1)]
