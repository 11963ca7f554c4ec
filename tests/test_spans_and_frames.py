"""Names, corrections, frames, regions and communities against plain searches."""

import math
import random
import re
import string

from pyspark.sql import functions as F

from brindle.operators import communities, entities, frames, graph, ocr
from brindle.operators.folds import within_edits
from tests.test_rounds_and_files import modularity, sequential

TRIM = ",.!?;:\"'()[]{}—–"


def is_title(t, more=""):
    return len(t) > 0 and t[0].isupper() and all(c.islower() or c in "'" + more for c in t[1:])


def brute_names(text):
    low = text.lower()
    if sum(s in low for s in entities.CODE_SIGNS) >= 3:
        return []
    tokens = [t for t in (x.strip(TRIM) for x in re.split("[ \n\r\t]", text)) if t.strip()]
    acronym = lambda t: len(t) <= 5 and t.isalpha() and t.isupper()
    opens = lambda t: t.lower() not in entities.STOP + entities.CODE and not acronym(t) and (t.lower() in entities.HONORIFICS or len(t) > 1 and is_title(t))
    goes_on = lambda t: t.lower() in entities.PLACES + entities.HONORIFICS or len(t) > 1 and is_title(t)
    found, i = {}, 0
    while i < len(tokens):
        if not opens(tokens[i]):
            i += 1
            continue
        j = i + 1
        while j < len(tokens) and goes_on(tokens[j]):
            j += 1
        name = " ".join(tokens[i:j])
        if len(name) > 2:
            found.setdefault(name.lower(), [name, 0])[1] += 1
        i = j
    out = []
    for name, n in sorted(found.values(), key=lambda x: -x[1]):
        words = name.split(" ")
        if words[0].lower() in entities.STOP and words[0].lower() not in entities.HONORIFICS:
            continue
        if name.lower() in entities.DAYS + entities.MONTHS + entities.PLACES + entities.HONORIFICS + entities.CODE or acronym(name) or len(words) == 1 and n < 2:
            continue
        if all(w.lower() in entities.HONORIFICS or len(words) > 1 and w.lower() in entities.PLACES or is_title(w, "-") for w in words):
            out.append((name, n))
    return out[:12]


def names(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {i: [] for i in range(len(texts))}
    for r in entities.proper_nouns(df, **options).orderBy("doc_id", "place").collect():
        got[r.doc_id].append((r["name"], r.n))
    return [got[i] for i in range(len(texts))]


def test_names_by_the_rules(spark):
    told = [
        "Mr. Holmes met Doctor. Then Inspector Lestrade of Baker Street came; Lestrade, said Holmes. Holmes went to Lauriston Gardens on Monday.",
        "However Alice ran. alice slept. The NASA and the API. Once Bob. MARY MARY Mary-Ann",
        "Tom's dog and tom's cat. Tom's bird; TOM'S",
        "function class void Anna Anna Anna", "", None, "   \n", "Captain", "Miss Marple " + "x " * 40_000 + "Miss Marple",
        "Anna Karl Anna karl ANNA Karl", "É. Élan met Élan and Ægir", "Lord\tByron\nLord Byron lord byron",
    ]
    got = names(spark, told)
    assert got == [brute_names(t or "") for t in told]
    assert ("Mr Holmes", 1) in got[0] and ("Lauriston Gardens", 1) in got[0] and not any(n == "Monday" for n, _ in got[0])
    assert got[3] == [] and got[8] == [("Miss Marple", 2)]
    assert names(spark, ["Anna met Anna"], kind=F.lit("expository")) == [[]]
    assert names(spark, told[3:4], kind=F.lit("narrative")) == [[("Anna Anna Anna", 1)]]


def test_names_in_random_texts(spark):
    rng = random.Random(2)
    words = ["Anna", "Karl", "anna", "Mr.", "Lady", "Street", "the", "The", "However", "API", "May", "St", "BBC", "O'Neil", "Mary-Ann", "Élan", "x", "void", "Monday,", "(Karl)", "\"Anna", "McCoy", "—", "I"]
    texts = [rng.choice([" ", "  ", "\n"]).join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(150)]
    assert names(spark, texts) == [brute_names(t) for t in texts]


def brute_corrected(text):
    digit, letter = (lambda c: c in string.digits), (lambda c: c in string.ascii_letters)
    out, n = [], 0
    for i, c in enumerate(text):
        around = [text[j] for j in (i - 1, i + 1) if 0 <= j < len(text)]
        if c in ocr.LETTER_TO_NUMBER and all(map(digit, around)):
            c, n = ocr.LETTER_TO_NUMBER[c], n + 1
        elif c in ocr.NUMBER_TO_LETTER and all(map(letter, around)):
            c, n = ocr.NUMBER_TO_LETTER[c], n + 1
        out.append(c)
    first = now = "".join(out)
    for wrong, right in ocr.PAIRS.items():
        before, now = now, now.replace(wrong, right)
        n += len(before) - len(now) if len(wrong) != len(right) else first.count(wrong) - now.count(wrong)
    words = now.split(" ")
    for i, w in enumerate(words):
        bare = w.strip(" \t\n\r\f\v")
        if bare.lower() in ocr.WORDS:
            fix = ocr.WORDS[bare.lower()]
            if all(c.islower() for c in fix) and bare[0].isupper():
                fix = fix[0].upper() + fix[1:]
            words[i], n = w.replace(bare, fix, 1), n + 1
    return " ".join(words), n


def test_three_phases_of_corrections(spark):
    rng = random.Random(6)
    parts = ["1O5", "O", "h0use", "b1ll", "l0", "rn", "vv", "tne", "Tne", "dont", "Cant", "l", "I", " ,", " .", ",,", "` ", " '", "fi", "ii", "S5", "5S5S5", "aOb", "0", "x\n", "\tl", "wlll\n", "漢", "é0é", "cl"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 25))) for _ in range(300)] + ["", " ", None, "1O" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {r.k: (r.t, r.corrections) for r in ocr.corrected(df, "k", "t").collect()}
    assert [got[i] for i in range(len(texts))] == [(None, 0) if t is None else brute_corrected(t) for t in texts]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_closest_words_equal_a_full_search(spark):
    rng = random.Random(9)
    letters = "abcdeé"
    known = list(dict.fromkeys("".join(rng.choice(letters) for _ in range(rng.choice([3, 4, 5, 6, 8, 12, 15, 17, 19, 24, 40]))) for _ in range(10_000)))
    known += ["q" * 400, "Ende", "q" * 399]

    def changed(w):
        for _ in range(rng.randint(0, 4)):
            p = rng.randrange(len(w) + 1)
            w = rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice(letters) + w[p:], w[:p] + rng.choice(letters) + w[p + 1 :]])
        return w

    words = [changed(w) for w in rng.sample(known, 150)] + ["q" * 401, "ENDE", "zzz", "q" * 395]
    words = [w for w in dict.fromkeys(words) if w]
    place = {w: k for k, w in enumerate(known)}
    by_length = {}
    for w in known:
        by_length.setdefault(len(w), []).append(w)
    want = {}
    for w in words:
        near = [(edits(w.lower(), c.lower()), place[c], c) for n in range(len(w) - 2, len(w) + 3) for c in by_length.get(n, []) if within_edits(w.lower(), c.lower(), 2)]
        if near:
            d, _, c = min(near)
            want[w] = (c, d)
    dictionary = spark.createDataFrame([(w, k) for w, k in place.items()], "word string, place long")
    got = {r.word: (r.match, r.distance) for r in ocr.closest(spark.createDataFrame([(w,) for w in words], "word string"), dictionary).collect()}
    assert got == want and len(want) > 80


def test_dictionary_phase(spark):
    dictionary = spark.createDataFrame([("house", 1), ("horse", 2), ("Garden", 3)], "word string, place long")
    texts = ["the houze, (hose) HOUSE!", "gardn. Gardenn  x", None, "", "ho hxxxe"]
    got = {r.k: (r.t, r.corrections) for r in ocr.by_dictionary(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t", dictionary).collect()}
    assert got == {0: ("the house, (hose) HOUSE!", 1), 1: ("Garden. Garden  x", 2), 2: (None, 0), 3: ("", 0), 4: ("ho hxxxe", 0)}


def sequential_regions(rows):
    merged, used = [], set()
    for i, (x, y, w, h, m) in enumerate(rows):
        if i in used:
            continue
        total, n = m, 1
        for j in range(i + 1, len(rows)):
            a, b, c, d, e = rows[j]
            if j not in used and x < a + c and x + w > a and y < b + d and y + h > b:
                r, s = max(x + w, a + c), max(y + h, b + d)
                x, y = min(x, a), min(y, b)
                w, h, total, n = r - x, s - y, total + e, n + 1
                used.add(j)
        merged.append((x, y, w, h, total / n, n))
    return sorted(merged, key=lambda r: -r[4])[:5]


def test_regions_merge_as_a_sequential_search_does(spark):
    rng = random.Random(4)
    rows = {i: [(float(rng.randint(0, 300)), float(rng.randint(0, 300)), float(rng.randint(1, 60)), float(rng.randint(1, 60)), float(rng.randint(1, 50))) for _ in range(rng.choice([1, 2, 5, 40, 400]))] for i in range(25)}
    df = spark.createDataFrame([(i, k, *r) for i, all_rows in rows.items() for k, r in enumerate(all_rows)] + [(99, 0, None, 1.0, 1.0, 1.0, 1.0)], "image long, region long, x double, y double, width double, height double, magnitude double")
    got = {}
    for r in frames.merged_regions(df.repartition(7)).orderBy("image", "place").collect():
        got.setdefault(r.image, []).append(tuple(r)[2:])
    assert {i: [tuple(map(float, x)) for x in v] for i, v in got.items()} == {i: [tuple(map(float, x)) for x in sequential_regions(v)] for i, v in rows.items()}
    assert frames.merged_regions(df.limit(0)).collect() == []


def test_motion_of_few_frames(spark):
    rows = [(1, 2.0, 3.0, 0.6, 10.0, 0), (1, 2.0, 3.0, 0.6, 350.0, 0), (2, 5.0, 9.0, 0.9, 90.0, 2), (3, 0.001, 0.0, 0.0, 0.0, 8), (3, 0.001, 0.0, 0.0, 180.0, 8), (4, 1.0, 1.0, 0.9, 20.0, 3), (4, 3.0, 5.0, 0.9, 30.0, 1)]
    got = {r.image: r for r in frames.motion(spark.createDataFrame(rows, "image long, magnitude double, max_magnitude double, activity double, angle double, direction int")).collect()}
    # the mean of 10 and 350 is 180; both differ by 170, which is not turned
    assert math.isclose(got[1].direction_consistency, 1 - 170 / 180) and got[1].motion_type == "oscillating"
    assert (got[2].direction_consistency, got[2].temporal_consistency, got[2].direction, got[2].motion_type) == (1.0, 1.0, "down", "panning")
    assert (got[3].has_motion, got[3].temporal_consistency, got[3].motion_type, got[3].direction) == (False, 1.0, "static", "stationary")
    assert got[4].direction == "down-right" and math.isclose(got[4].temporal_consistency, 0.5)


def test_columns_open_in_order(spark):
    def count(centres, width=100):
        return spark.range(1).select(frames.columns(F.array(*map(F.lit, centres)).cast("array<long>"), F.lit(width)).alias("n")).first().n

    assert [count(c) for c in ([10], [10, 50], [10, 49], [10, 50, 90], [50, 10, 90], [])] == [1, 2, 1, 3, 3, 1]


def test_components_reach_the_fixed_point(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(200)] + [(500, k) for k in range(501, 800)] + [(900, 900), (None, 3)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    want = {x: find(x) for x in list(up)}
    got = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def random_groups(rng, n, size):
    edges = {}
    for a in range(n):
        for b in range(a):
            if rng.random() < (0.6 if a // size == b // size else 0.04):
                edges[b, a] = rng.choice([1.0, 2.0])
    return edges


def test_communities_with_the_default_arguments(spark):
    rng = random.Random(3)
    edges = random_groups(rng, 60, 12)
    both = graph.undirected(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight double"))
    label = {r.node: r.community for r in communities.louvain(both, least=1).collect()}
    assert set(label) == set(range(60))
    assert modularity(edges, label) >= modularity(edges, sequential(edges, rng)) - 1e-9


def test_rounds_of_joins_end_where_no_node_gains(spark):
    edges = random_groups(random.Random(3), 24, 8)
    both = graph.undirected(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight double")).cache()
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    for k, v in zip(kept, ("2", "false"), strict=True):  # tiny joins, many of them
        spark.conf.set(k, v)
    try:
        label = {r.node: r.label for r in communities.local_moving(both).collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    near = {}
    for (a, b), w in edges.items():
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {})[a] = w
    m2 = sum(sum(x.values()) for x in near.values())
    sigma = {}
    for v, x in near.items():
        sigma[label[v]] = sigma.get(label[v], 0) + sum(x.values())
    for v, x in near.items():
        inside, k = {}, sum(x.values())
        for w, weight in x.items():
            inside[label[w]] = inside.get(label[w], 0) + weight
        value = lambda c: inside.get(c, 0) / m2 - k * (sigma[c] - (k if c == label[v] else 0)) / m2**2  # noqa: B023, E731
        assert all(value(c) <= value(label[v]) + 1e-8 for c in inside)


def test_local_moving_ends_where_no_node_gains(spark):
    rng = random.Random(8)
    n, edges = 3000, {}
    for a in range(n):
        for _ in range(4):
            b = rng.randrange(a // 50 * 50, min(n, a // 50 * 50 + 50)) if rng.random() < 0.8 else rng.randrange(n)
            if a != b:
                edges[min(a, b), max(a, b)] = 1.0
    both = graph.undirected(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight double"))
    label = {r.node: r.community for r in communities.louvain(both, levels=1, least=1).collect()}
    near, m2 = {}, 2 * len(edges)
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    sigma = {}
    for v, x in near.items():
        sigma[label[v]] = sigma.get(label[v], 0) + len(x)
    for v, x in near.items():
        inside = {}
        for w in x:
            inside[label[w]] = inside.get(label[w], 0) + 1
        own = label[v]
        value = lambda c: inside.get(c, 0) / m2 - len(x) * (sigma[c] - (len(x) if c == own else 0)) / m2**2  # noqa: B023, E731
        assert all(value(c) <= value(own) + 1e-8 for c in inside)
