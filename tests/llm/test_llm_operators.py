"""Each operator against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from equivox.llm import components, decontaminate, fingerprints, html_blocks, mixing, repeats, secrets_forest, sharding, simhash, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioubdst") for _ in range(rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(rng.randint(5, 60))).replace(" a ", "\n") for _ in range(30)]
    texts = base + [base[3], base[3], base[4] + " tail", "start " + base[5], base[6][:90] + base[7]]
    out = [(k, t, f"s{k % 4}" if k % 7 else None) for k, t in enumerate(texts)]
    return [*out, (100, None, "s1"), (101, "", "s1"), (None, base[8], None), (3, base[3], "s3"), (102, "one", "s0"), (103, base[9] * 40, "s0"), (104, "x" * 5000, "s2")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def paragraphs(text):
    return {p for p in (text or "").split("\n") if p.strip(" ")}


def test_fingerprints(docs, rows, none):
    got = fingerprints.fingerprints(docs, per_bucket=5).collect()
    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter()
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        near = [len(a & b) / len(a | b) if a | b else 1.0 for a, b in ((paragraphs(t), paragraphs(edited)), (paragraphs(t), paragraphs(after)))]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *(round(x, 9) for x in near)] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
    by_text = {}
    text_of = {i: t or "" for i, t, _ in rows}
    for r in got:
        assert by_text.setdefault(text_of[r.doc_id], r.fingerprint) == r.fingerprint
        assert r.decoded
    assert fingerprints.fingerprints(none).count() == 0


def test_fingerprints_retry_larger(spark):
    a, b = list(range(1, 400)), list(range(300, 900))
    digest = lambda c: F.transform(F.col(c), lambda x: (F.xxhash64(x).bitwiseAND(F.lit(-(1 << 24)))).bitwiseOR(fingerprints.check(F.xxhash64(x).bitwiseAND(F.lit(-(1 << 24))))))
    df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(digest("a").alias("a"), digest("b").alias("b"))
    small = fingerprints.decode_small(fingerprints.small_sketch(F.col("a")), fingerprints.small_sketch(F.col("b")))
    r = df.withColumn("p", fingerprints.parted(F.col("a"), F.col("b"))).select("a", "b", small.alias("s"), fingerprints.decode_large(F.col("p")).alias("l")).first()
    assert not r.s.ok and r.l.ok
    assert sorted(r.l.found) == sorted(set(r.a) ^ set(r.b))


def test_fingerprints_always_recover_the_difference(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "LARGER", (1, 2))  # sketches far too small
    df = spark.createDataFrame([(list(range(1, 60)), list(range(40, 90))), ([], [1, 2]), (list(range(9)), list(range(9)))], "a array<long>, b array<long>")
    for r in df.withColumn("p", fingerprints.parted(F.col("a"), F.col("b"))).select("a", "b", fingerprints.decode_large(F.col("p")).alias("l")).collect():
        assert sorted(r.l.found) == sorted(set(r.a) ^ set(r.b))


def test_fingerprints_of_very_long_texts(spark):
    lines = [f"line {k} of a long text" for k in range(20_000)]
    df = frame(spark, [(1, "\n".join(lines), "s"), (2, "\n".join(lines[:15_000] + [f"other {k}" for k in range(3_000)]), "s")])
    got = {r.doc_id: r for r in fingerprints.fingerprints(df).collect()}
    assert got[1].near_next == pytest.approx(15_000 / 23_000) == got[2].near_next


def brute_print(text):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows, none):
    got = simhash.near_groups(docs).collect()
    prints = [(i, brute_print(t)) for i, t, _ in rows]
    assert Counter((r.doc_id, r.fp % (1 << 64)) for r in got) == Counter(prints)
    parent = list(range(len(prints)))
    find = lambda k: k if parent[k] == k else find(parent[k])
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((i, least.get(find(k))) for k, (i, _) in enumerate(prints))
    assert simhash.near_groups(none).count() == 0
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) >= set(least.values())


def test_simhash_dense_groups_lose_no_link(spark):
    rng = random.Random(1)
    fps = {0x123456789ABCDEF0}
    for _ in range(400):  # a chain and a ball around many centres
        fps.add(rng.choice(sorted(fps)) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
    fps |= {rng.getrandbits(64) for _ in range(50)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    roots = {r.node: r.root for r in components.components(edges).collect()}
    xs = [np.uint64(x) for x in fps]
    left, n = set(range(len(xs))), 0
    while left:
        n, todo = n + 1, [left.pop()]
        names = {roots.get(int(xs[todo[0]].view(np.int64)), int(xs[todo[0]].view(np.int64)))}
        while todo:
            a = todo.pop()
            near = {b for b in left if int(xs[a] ^ xs[b]).bit_count() <= 3}
            names |= {roots.get(int(xs[b].view(np.int64)), int(xs[b].view(np.int64))) for b in near}
            left -= near
            todo += near
        assert len(names) == 1


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 101), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def test_decontamination(spark, docs, rows, none):
    long = next(t for i, t, _ in rows if i == 20)
    items = [(0, " ".join(long.split()[2:20])), (1, "nothing of this occurs anywhere here"), (2, rows[3][1].upper()), (3, ""), (4, None), (5, "one"), (0, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    of_item, of_doc = {}, {}
    for i, t in items:
        w = cut(t)
        if w:
            of_item.setdefault((i, min(5, len(w))), set()).update(grams(w, min(5, len(w))))
    for i, t, _ in rows:
        for n in range(1, 6):
            of_doc.setdefault((i, n), set()).update(grams(cut(t), n))
    want = {(d, i) for (i, n), s in of_item.items() for (d, m), g in of_doc.items() if m == n and len(s & g) >= 0.8 * len(s)}
    got = decontaminate.contained(docs, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert decontaminate.contained(none, bench).count() == 0 == decontaminate.contained(docs, bench.limit(0)).count()
    bad = {d for d, _ in want}
    assert Counter(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == Counter(i for i, _, _ in rows if i not in bad)


def test_mixing(docs, rows, none):
    words = lambda t: len((t or "").encode().split())
    sized, blocks = mixing.mix_plan(docs)
    got = mixing.to_block(sized, blocks).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    order = sorted(sizes, key=mixing.order_of)
    goal = dict(zip(order, mixing.targets([sizes[s] for s in order]), strict=True))
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6 and len(r.draws) <= 2
        taken[r.source] = taken.get(r.source, 0) + r.size * len(r.draws)
    for s in order:
        assert goal[s] - max(words(t) for _, t, q in rows if q == s) <= taken[s] <= goal[s] + 1e-6
    assert abs(sum(goal.values()) - 1.5 * sum(sizes.values())) < 1e-6
    again = mixing.to_block(*mixing.mix_plan(docs.repartition(5))).collect()
    assert Counter((r.doc_id, r.source, tuple(r.draws)) for r in again) == Counter((r.doc_id, r.source, tuple(r.draws)) for r in got)
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "mix_shard"] and mixed.count() == sum(len(r.draws) for r in got)
    assert mixing.mix(none).count() == 0


def test_mixing_tree_deals_exact_quotas():
    quota = np.array([70, 0, 13, 5])
    dealt = mixing.split(quota, 7, np.random.default_rng(0))
    assert (dealt.sum(0) == quota).all() and (dealt >= 0).all() and np.ptp(dealt.sum(1)) <= 1
    assert mixing.targets([100, 100, 100], (5, 2, 1), 1.5, 2) == pytest.approx([200, 500 / 3, 250 / 3])


def test_tokens_equal_the_library(docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    count = lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
    want = Counter((i, len((x or "").encode()), count(x), count(x) > 512) for i, x, _ in rows)
    assert Counter(map(tuple, tokens.token_counts(docs).collect())) == want
    assert tokens.token_counts(none).count() == 0
    own, rng = tokens.counter("byte_bpe_50k.json", ""), random.Random(2)
    for _ in range(1500):
        x = "".join(rng.choice("ab Z'stre \n\t\x1c\x85\xa0　é１½_!<|endoftext|>日🙂́") for _ in range(rng.randint(0, 14))) + rng.choice(["", "<|endoftext|> a"])
        assert own(x) == count(x)


def test_sharding(docs, rows, none):
    for limit in (400, 3000, 10**7):
        size = {}
        for i, t, _ in rows:
            h = int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
            size[h] = size.get(h, 0) + len((t or "").encode())
        shard_of, todo = {}, [("", list(size))]
        while todo:
            p, hs = todo.pop()
            if sum(size[h] for h in hs) <= limit or len(hs) == 1:
                shard_of |= dict.fromkeys(hs, p)
                continue
            for bit in "01":
                own = [h for h in hs if f"{h:060b}"[len(p)] == bit]
                if own:
                    todo.append((p + bit, own))
        got = sharding.shard(docs, limit)
        assert got.columns[: len(docs.columns)] == docs.columns
        hashed = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
        assert Counter((r.doc_id, r.shard) for r in got.collect()) == Counter((i, shard_of[hashed(i)]) for i, _, _ in rows)
    assert sharding.shard(none).count() == 0


def brute_repeats(rows, n=50):
    first = {}
    for i, t, _ in rows:
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            key = (2**63 if i is None else i)
            first[b[k : k + n]] = min(first.get(b[k : k + n], key), key)
    out = Counter()
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if first[b[k : k + n]] < (2**63 if i is None else i):
                gone[k : k + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_suffix_array_dedup(spark, docs, rows, none):
    assert Counter(map(tuple, repeats.without_repeats(docs).collect())) == brute_repeats(rows)
    rng = random.Random(3)
    piece = ["".join(rng.choice("ab") for _ in range(rng.randint(30, 70))) for _ in range(12)]
    dense = [(k, "".join(rng.choice(piece) for _ in range(rng.randint(0, 8))) + "é" * (k % 3), "s") for k in range(60)]
    assert Counter(map(tuple, repeats.without_repeats(frame(spark, dense)).collect())) == brute_repeats(dense)
    assert repeats.without_repeats(none).count() == 0
    odd = [(2**63 - 1, piece[0] * 2, "s"), (None, piece[1] * 3, "s"), (4, piece[1] * 3, "s"), (5, "a\0b\0" * 40, "s"), (6, "\0" * 120, "s"), (7, "b\0a\0" * 40 + "\0" * 60, "s"), (8, None, "s")]
    assert Counter(map(tuple, repeats.without_repeats(frame(spark, odd)).collect())) == brute_repeats(odd)


def test_suffix_array_of_spans():
    rng = random.Random(9)
    spans = [bytes(rng.choice(b"a\0") for _ in range(rng.randint(3, 12))) for _ in range(60)]
    text = np.frombuffer(b"".join(spans), np.uint8)
    sizes = np.array([len(s) for s in spans])
    of = np.repeat(np.arange(len(spans)), sizes)
    starts = np.arange(len(text))
    left = np.cumsum(sizes)[of] - starts
    order, lcp = repeats.suffix_array(text, starts, left)
    suffixes = [bytes(text[starts[k] : starts[k] + left[k]]) for k in order]
    assert suffixes == sorted(suffixes)
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert lcp.tolist() == [0, *(common(a, b) for a, b in zip(suffixes, suffixes[1:], strict=False))]


def test_maximal_repeats():
    rng = random.Random(4)
    for _ in range(20):
        texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 25))).encode() for _ in range(4)]
        where = {}
        for k, t in enumerate(texts):
            for a in range(len(t)):
                for b in range(a + 3, len(t) + 1):
                    where.setdefault(t[a:b], []).append((k, a))
        want = {}
        for s, at in where.items():
            left = {texts[k][a - 1 : a] if a else (k, a) for k, a in at}
            right = {texts[k][a + len(s) : a + len(s) + 1] or (k, a) for k, a in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want[s] = sorted(at)
        assert dict(repeats.maximal_repeats(texts, 3)) == want


def test_toxicity(spark, none):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["ton", "er", "in", "the", "an", "ou", "is"]) for _ in range(rng.randint(1, 3)))
    bad = ["idiot", "clown", "trash"]
    rows, marks = [], []
    for k in range(600):
        w = [word() for _ in range(30)]
        if k % 5 == 0:
            w[rng.randrange(30)] = rng.choice(bad)
        rows.append((k, " ".join(w), "s"))
        marks.append((k, int(k % 5 == 0)))
    extra = [(1000, "an 1d10t in the ton", "s"), (1001, "the cl0wn is an", "s"), (1002, "is i d i o t in", "s"), (1003, "the traaaaash is in", "s"), (1004, "", "s"), (1005, None, "s"), (None, "the in an is", "s"), (1006, "the in an is", "s")]
    labels = spark.createDataFrame([*marks, (None, 1), (7, None)], "doc_id long, toxic int")
    df = frame(spark, rows + extra)
    got = {r.doc_id: r for r in toxicity.scores(df, labels).collect()}
    held = [k for k in range(600) if got[k].held_out]
    assert 60 < len(held) < 250 and all(got[k].predicted == int(k % 5 == 0) for k in held)
    assert [got[k].predicted for k in (1000, 1001, 1002, 1003, 1004, 1005, 1006)] == [1, 1, 1, 1, 0, 0, 0]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1004].score == got[1005].score
    kept = toxicity.drop_toxic(df, labels)
    assert kept.schema == df.schema and {r.doc_id for r in kept.collect()} == {k for k in got if not got[k].predicted}
    assert toxicity.scores(none, labels).count() == 0 and toxicity.scores(df, labels.limit(0)).count() == len(rows + extra)


def test_html(spark):
    xs, ys = html_blocks.examples(150, 1234)
    labels = html_blocks.label(xs, html_blocks.network())
    assert np.mean(np.concatenate(labels) == (np.concatenate(ys) > 0)) > 0.98
    page = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li><li><a href="/b">Other</a></li></ul></nav><!-- ad --><div class="ad">Buy this now.</div><article><h1>A &amp; B</h1><p><b>First&nbsp;part\n here.<br>More of it.<p>Second paragraph, with caf&eacute; in it.</p></article><footer>&copy; somebody</footer></body></html>'
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (None, None, page), (1, "u", page)]
    got = html_blocks.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = "A & B First part here. More of it. Second paragraph, with café in it."
    assert Counter(map(tuple, got)) == Counter([(1, "u", text, len(text)), (2, "u", "", 0), (3, "u", "", 0), (None, None, text, len(text)), (1, "u", text, len(text))])


def test_html_of_long_deep_and_odd_pages(spark):
    p = html_blocks.network()
    for page, _ in html_blocks.training_pages(40, 78):
        found = html_blocks.blocks(page)
        if found:
            assert (html_blocks.label_long(found, p, 3) == html_blocks.label([html_blocks.features(found)], p)[0]).all()
    frame_of = lambda inner: f"<html><body><nav><ul><li><a href=/x>Menu</a></li><li><a href=/y>Other</a></li></ul></nav><article><h1>A title</h1>{inner}</article><footer>&copy; somebody</footer></body></html>"
    body = [f"Paragraph {k} of a long article, with some words in it." for k in range(20_000)]
    rows = [(1, "u", frame_of("".join(f"<p>{t}</p>" for t in body))), (2, "u", frame_of("<p>The area is <math><mi>a</mi><mo>=</mo><mi>b</mi></math> here, as every one of us knows.</p>")),
            (3, "u", "<div>" * 30_000 + "text" + "</p>" * 30_000), (4, "u", "<a " * 200_000), (5, "u", "no markup at all"), (6, "u", None)]
    got = {r.page_id: r.text for r in html_blocks.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    kept = got[1].count("Paragraph")
    assert kept > 19_900 and "Menu" not in got[1] and "somebody" not in got[1]
    assert "a=b here" in got[2] and len(got) == 6 and got[6] == ""
    assert html_blocks.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


def test_html_gradients():
    rng = np.random.default_rng(0)
    x, mask = rng.standard_normal((4, 2, 3)).astype(np.float32), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    h = html_blocks.HIDDEN
    w, u, b = (rng.standard_normal(s).astype(np.float32) * 0.3 for s in ((3, 4 * h), (h, 4 * h), (4 * h,)))
    weight = rng.standard_normal((4, 2, h)).astype(np.float32) * mask[..., None]
    loss = lambda: float((html_blocks.run_lstm(x, mask, w, u, b, False)[0] * weight).sum())
    dw, du, db = html_blocks.back_lstm(x, html_blocks.run_lstm(x, mask, w, u, b, True)[1], u, weight)
    for of, grad in ((w, dw), (u, du), (b, db)):
        for _ in range(6):
            at = tuple(int(rng.integers(n)) for n in of.shape)
            old = of[at]
            of[at] = old + 1e-2
            up = loss()
            of[at] = old - 1e-2
            down = loss()
            of[at] = old
            assert abs((up - down) / 2e-2 - grad[at]) < 0.02 * max(1, abs(grad[at]))


def test_secrets(spark, none):
    forest = secrets_forest.default_forest()
    held = secrets_forest.labelled_findings(600, 99)
    p = forest(np.array([secrets_forest.features(*f[:4]) for f in held]))
    assert np.mean((p >= 0.5) == np.array([f[4] for f in held])) > 0.97
    key, sha = "8b540ef2c226668020056c2469c653445539f8d7", "da39a3ee5e6b4b0d3255bfef95601890afd80709"
    rows = [(1, f'some words token = "{key}" more words', "src1"), (2, f"fixed in commit {sha} of the tree", "docs/readme.md"), (3, None, None), (4, "", "s"), (None, f'token = "{key}"', None)]
    got = {(r.doc_id, r.candidate): r.is_secret for r in secrets_forest.scan(frame(spark, rows)).collect()}
    assert got == {(1, key): True, (2, sha): False, (None, key): True}
    assert secrets_forest.scan(none).count() == 0


def test_near_copies_thin_rows_not_ids(spark):
    rng = random.Random(13)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    a, b, c, d = text(), text(), text(), text()
    rows = [(None, a, "s"), (None, b, "s"), (None, b, "s"), (5, c, "s"), (5, d, "s"), (4, c, "s")]
    got = simhash.drop_near_copies(frame(spark, rows))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(None, a), (None, b), (4, c), (5, d)])


def test_near_copies_of_the_stage(spark):
    rng = random.Random(12)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randint(4, 90))] for _ in range(25)]
    texts = [" ".join(w) for w in base] + ["", "  ", "one two"]
    for _ in range(120):  # near copies of near copies, around and below the similarity
        w = rng.choice(texts[:25]).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    hot = [f"h{k}" for k in range(60)]
    texts += [" ".join(hot[:-1] + [f"t{k}"]) for k in range(90)]
    texts += [" ".join([f"c{k}" for k in range(12)] + [f"u{k}x{j}" for j in range(3)]) for k in range(50)]
    rows = [(k if k % 3 else None, t, "s") for k, t in enumerate(texts)]
    rows += [(1, "a text of its own with no like", "s"), (1, "and another text under that very id", "s"), rows[1]]
    sets = [set(simhash.shingle_set(t, 5).tolist()) for _, t, _ in rows]
    parent = list(range(len(rows)))
    find = lambda k: k if parent[k] == k else find(parent[k])
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), 2**63), 2**63 if i is None else i)
    got = [(r.doc_id, r.text) for r in simhash.drop_near_copies(frame(spark, rows), words=5, similarity=0.8).collect()]
    assert Counter(2**63 if i is None else i for i, _ in got) == Counter(least.values())
    assert len({find([t for _, t, _ in rows].index(t)) for _, t in got}) == len(got)


def test_toxicity_restores_long_tokens():
    words = "you are an idiot and the others are not".split()
    rng = random.Random(8)
    counts = np.zeros((toxicity.SIZE,) * 3)
    np.add.at(counts.reshape(-1), toxicity.trigrams(" ".join(rng.choice(words) for _ in range(3000))), 1)
    restorer = toxicity.Restorer(np.log((counts + 0.01) / (counts + 0.01).sum(2, keepdims=True)))
    assert "idiot" in restorer.words("the idi" + "o" * 300 + "t")
    assert {"idiot", "others"} <= restorer.words(".".join(["the", "others"] * 30 + ["idiot"] + ["and"] * 30))
    assert "idiot" in restorer.words(".".join(["and"] * 60 + ["1d10t"]))
    spaced = " ".join("".join(words * 5))
    assert len(spaced) > 200 and "idiot" in " ".join(sorted(restorer.words(spaced)))
    assert restorer.words(".".join(["a"] * 50_000)) is not None


def test_decontamination_judges_rows_whatever_their_ids(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    other = "red green blue black white brown grey pink gold silver bronze copper"
    clean = "a clean text that holds nothing of what was named above at all"
    docs = frame(spark, [(None, f"so {passage} it goes", "s"), (None, clean, "s"), (7, f"so {other} it goes", "s"), (7, clean, "s"), (8, passage[:30], "s"), (8, passage[24:], "s")])
    bench = spark.createDataFrame([(None, passage), (1, other), (1, "quite another passage that has more words than the first one had")], "item_id long, text string")
    assert Counter((r.doc_id, r.item_id) for r in decontaminate.contained(docs, bench).collect()) == Counter([(None, None), (7, 1)])
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(None, clean), (7, clean), (8, passage[:30]), (8, passage[24:])])


def test_maximal_repeats_of_whole_and_long_texts():
    assert repeats.maximal_repeats([b"abcdef", b"abcdef"], 3) == [(b"abcdef", [(0, 0), (1, 0)])]
    rng = random.Random(14)
    long = bytes(rng.randrange(256) for _ in range(6000))
    assert repeats.maximal_repeats([long, b"\0" + long + b"\0", b""], 50) == [(long, [(0, 0), (1, 1)])]
    assert repeats.maximal_repeats([], 3) == [] == repeats.maximal_repeats([b"", b"ab"], 3)


def test_the_mixture_stage_shuffles_within_shards(spark):
    import corpus_pipeline

    df = frame(spark, [(k, f"some words of {k}", f"s{k % 3}") for k in range(300)]).coalesce(1)
    got = [r.doc_id for r in corpus_pipeline.mixture(spark, df, "").collect()]
    assert got == [r.doc_id for r in mixing.mix(df).collect()]
    shards = {}
    for r in mixing.mix(df).collect():
        shards.setdefault(r.mix_shard, []).append(r.doc_id)
    assert any(x != sorted(x) for x in shards.values())
    assert got != [r.doc_id for r in mixing.mix(df, shuffle=False).collect()]
