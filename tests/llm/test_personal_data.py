import hashlib
import itertools
import math
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from bitloom.llm import personal_data as p


def contract(text):
    """The base patterns, read plainly."""
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


PARTS = ["a", "Zz9", "@", ".", "..", "_", "%", "+", "-", " ", "1", "255", "256", "4111111111111111", "4111-1111", "+1 (988) 555-2485", "é", "\n", "(", ")", "0", "b.co", "10.0.0.1", "x@y.z", "001", "٣"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=16))
def test_base_spans_are_the_contract(parts):
    text = "".join(parts)
    base, every = p.find(text, p.fitted())
    assert base == contract(text) and set(base) <= set(every)


def region(text="call 212-555-1234 or 10.1.2.3"):
    return p.Region(text, 0, len(text))


def paths(model, r):
    """All segmentations with their scores."""

    def go(j, last, score, segments):
        if j == r.n:
            yield score, segments
            return
        for e in range(j + 1, r.n + 1):
            for i, kind, names in model.arcs(r, e):
                if i == j:
                    own = model.score(names) + model.weights.get(f"{last}>{kind}", 0)
                    yield from go(e, kind, score + own, segments + ([(kind, r.tokens[i][0], r.tokens[e - 1][1])] if kind != p.OTHER else []))

    return list(go(0, p.OTHER, 0.0, []))


def test_decoding_is_the_best_of_all_segmentations():
    rng = random.Random(1)
    r = region()
    names = {n for e in r.ending for _, _, ns in e for n in ns} | {f"{a}>{b}" for a, b in itertools.product(range(5), repeat=2)}
    for _ in range(20):
        model = p.Model({n: rng.uniform(-2, 2) for n in names})
        every = paths(model, r)
        assert model.best(r) == max(every, key=lambda x: x[0])[1]


def test_gradient_is_the_slope_of_the_likelihood():
    rng = random.Random(2)
    r = region("x 212-555-1234 y")
    gold = {(i, j): k for j, e in enumerate(r.ending) for i, k, _ in e if k == 3}
    gold = dict([max(gold.items(), key=lambda g: g[0][1] - g[0][0])])
    names = {n for e in r.ending for _, _, ns in e for n in ns} | {f"{a}>{b}" for a, b in itertools.product((3, 4), repeat=2)}
    model = p.Model({n: rng.uniform(-1, 1) for n in names})
    value, slope = model.gradient(r, gold)
    want = [(k, r.tokens[i][0], r.tokens[j - 1][1]) for (i, j), k in gold.items()]
    every = paths(model, r)
    assert abs(value - (next(s for s, x in every if x == want) - math.log(sum(math.exp(s) for s, _ in every)))) < 1e-9
    for n in names:
        old = model.weights[n]
        ends = []
        for d in (1e-5, -1e-5):
            model.weights[n] = old + d
            ends.append(model.gradient(r, gold)[0])
        model.weights[n] = old
        assert abs((ends[0] - ends[1]) / 2e-5 - slope.get(n, 0)) < 1e-5


def test_fresh_sentences():
    rng, right, known, extra = random.Random(5), 0, 0, 0
    for _ in range(300):
        text, gold = p._invented(rng)
        base, every = p.find(text, p.fitted())
        right += len(set(gold) & set(every))
        known += len(gold)
        extra += len(set(every) - set(gold) - set(base))
    assert right >= 0.9 * known and extra <= 0.05 * known


def test_less_common_forms_and_plain_prose():
    for text, want in (("mail bob [at] example [dot] com now", "email"), ("call (212) 555-1234 today", "phone"), ("from host 10[.]1[.]2[.]3 today", "ip")):
        assert [p.KINDS[k] for k, _, _ in p.find(text, p.fitted())[1]] == [want]
    for text in ("in 1999 and 2004-10-11, 3,500,000 of 12 people", "meet at 10 (at noon)", "chapter 4.2.1, see 17 and 18"):
        assert p.find(text, p.fitted()) == ([], [])


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1." * 50_000, "+1(" * 30_000, "9 " * 20_000):
        p.find(text, p.fitted())


def test_rows(spark, tmp_path):
    text = "é mail x.y@z.org or +1 (988) 555-2485"
    docs = spark.createDataFrame([(1, text, "s"), (1, text, "s"), (2, None, "s"), (None, "", "s")], "doc_id long, text string, spans string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(p.op5_personal_data(spark, str(tmp_path)).collect(), key=str)
    mine = [r for r in rows if r.doc_id == 1]
    assert len(rows) == 4 and len(mine) == 2
    assert (mine[0].n_email, mine[0].n_phone, mine[0].spans) == (1, 1, "email:7:16,phone:20:37")
    assert mine[0].base_sha256 == hashlib.sha256(b"email:7:16,phone:20:37").hexdigest()
    assert p.personal_data(docs.limit(0)).count() == 0
