import math
import random
import re

from llm.conftest import EDGES, WORDS, prose

from tallyforge.llm.decontamination import MASKS, WINDOW, find_overlaps, without_overlaps


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items):
    seeds = {}
    for item, text in items:
        w = words(text)
        for i in range(len(w)):
            for m, mask in enumerate(MASKS):
                if i + len(mask) <= len(w):
                    seeds.setdefault((m, *[w[i + k] for k, c in enumerate(mask) if c == "1"]), []).append((item, i, w))
    out, span = {}, min(map(len, MASKS))
    for doc, text in docs:
        w = words(text)
        for i in range(len(w)):
            for m, mask in enumerate(MASKS):
                if i + len(mask) > len(w):
                    continue
                for item, j, x in seeds.get((m, *[w[i + k] for k, c in enumerate(mask) if c == "1"]), ()):
                    best = max(sum(0 <= i + q < len(w) and 0 <= j + q < len(x) and w[i + q] == x[j + q] for q in range(s, s + WINDOW)) for s in range(span - WINDOW, 1))
                    if best >= math.ceil(0.8 * min(WINDOW, len(x))):
                        old = out.get((doc, item), (0, math.inf))
                        out[doc, item] = max(old[0], best), min(old[1], i)
    return out


def case():
    rnd = random.Random(11)
    items = [(k, prose(rnd, rnd.randint(14, 60))) for k in range(15)] + [(90, None), (91, "too short"), (92, "")]
    docs = list(EDGES)
    for _ in range(90):
        passage = words(rnd.choice(items[:15])[1])
        for _ in range(rnd.choice((0, 1, 2, 4, 8))):
            passage[rnd.randrange(len(passage))] = rnd.choice(WORDS)
        cut = passage[: rnd.choice((len(passage), len(passage) // 2, 12))]
        docs.append(f"{prose(rnd, rnd.randint(0, 40))}. {' '.join(cut).upper()}! {prose(rnd, rnd.randint(0, 40))}")
    docs += [prose(rnd, 60) for _ in range(20)] + [prose(rnd, 20_000) + " " + items[0][1]]
    return docs, items


def test_against_brute_force(spark, messy):
    docs, items = case()
    tests = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, seed string")
    table = messy(docs)
    got = {(r.doc_id, r.item_id): (r.agreeing_words, r.first_word) for r in find_overlaps(table, tests).collect()}
    wanted = brute(list(enumerate(docs)), items)
    assert got == wanted and len(wanted) > 20
    kept = without_overlaps(table, tests)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(range(len(docs))) - {d for d, _ in wanted})


def test_passages_with_substitutions_are_found(spark, messy):
    rnd = random.Random(2)
    passage = prose(rnd, 40)
    changed = passage.split()
    for k in (7, 19, 31):
        changed[k] = "other"
    tests = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = find_overlaps(messy([" ".join(changed), prose(rnd, 300)]), tests).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(0, 1)]


def test_short_items_and_scripts_without_blanks(spark, messy):
    items = [(1, "What is seven times six?"), (2, "Yes, indeed"), (3, "床前明月光，疑是地上霜。举头望明月，低头思故乡。"), (4, "which of these ten words is not one of them")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    docs = ["So WHAT is seven\ntimes six, then", "what is seven times six", "yes indeed", "well yes indeed", "他说床前明月光，疑是地上霜。举头望明月，低头思故乡。好", "what is six times seven", "x " * 30 + items[3][1], "明月"]
    got = sorted((r.doc_id, r.item_id, r.agreeing_words, r.first_word) for r in find_overlaps(messy(docs), tests).collect())
    assert got == [(0, 1, 5, 1), (1, 1, 5, 0), (2, 2, 2, 0), (4, 3, 20, 2), (6, 4, 10, 30)]
    assert sorted(r.doc_id for r in without_overlaps(messy(docs), tests).collect()) == [3, 5, 7]


def test_native_empty_and_repeated(spark, messy):
    tests = spark.createDataFrame([(1, prose(random.Random(1), 30))], "item_id long, text string")
    docs = messy([prose(random.Random(1), 30)] * 3, [None, 5, 5])
    found = find_overlaps(docs, tests)
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().executedPlan().toString())
    assert sorted((str(r.doc_id), r.item_id) for r in found.collect()) == [("5", 1), ("None", 1)]
    assert find_overlaps(docs.limit(0), tests).count() == 0
    assert find_overlaps(docs, tests.limit(0)).count() == 0
    assert without_overlaps(docs, tests.limit(0)).count() == 3


def test_the_plan_does_not_spell_the_filter_out(spark, messy):
    tests = spark.createDataFrame([(k, prose(random.Random(k), 30)) for k in range(3)], "item_id long, text string")
    found = find_overlaps(messy([prose(random.Random(1), 30), "other"]), tests)
    assert [(r.doc_id, r.item_id) for r in found.collect()] == [(0, 1)]
    # The driver makes and keeps such a text for every run, and again for every change of the plan.
    assert not re.search(r"(-?\d+, ?){1000}", found._jdf.queryExecution().executedPlan().toString())
