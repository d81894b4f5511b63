import random

import numpy as np
import pytest

from vaultsieve.llm import html, packing, quality, toxicity
from vaultsieve.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))
    docs, labels = [], []
    for i in range(900):
        words = [word() for _ in range(r.randint(5, 80))]
        toxic = int(i % 6 == 0)
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["Zkorx", "zkorx,", "wubbel"]))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, toxic))
    docs += [(900, None, "x"), (901, "", "x"), (None, "abc", "x")]
    labels += [(5000, 1), (None, 1), (3, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_documents(labelled):
    docs, labels = labelled
    found = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(found) == docs.count()
    held = [i for i in range(900) if found[i].held_out]
    assert 100 < len(held) < 260
    right = sum(found[i].predicted == int(i % 6 == 0) for i in held)
    assert right / len(held) > 0.97
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in found.values())
    assert found[900].score == found[901].score and found[901].predicted == 0


def test_toxicity_without_labels_or_rows(labelled):
    docs, labels = labelled
    assert {round(r.score, 6) for r in toxicity.score(docs.limit(5), labels.where("false")).collect()} == {round(1 / 3, 6)}
    assert toxicity.score(docs.where("false"), labels).count() == 0


def test_toxicity_carries_documents(labelled):
    docs, labels = labelled
    out = toxicity.score(docs, labels, carry=docs.columns).select("carried.*")
    assert out.exceptAll(docs).count() == 0 and out.count() == docs.count()


def test_newton_fit_equals_small_steps():
    from vaultsieve.llm.presence import Presence

    r = np.random.default_rng(1)
    x = r.random((60, 5)) < 0.4
    y = (x[:, 0] | (r.random(60) < 0.1)).astype(float)
    weight, bias = toxicity.fit(Presence([np.flatnonzero(v) for v in x], 5), y, np.ones(5), decay=1.0)
    w, b = np.zeros(5), 0.0
    for _ in range(20_000):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - 0.02 * (x.T @ e + w), b - 0.02 * e.sum()
    assert np.allclose(weight, w, atol=1e-2) and abs(bias - b) < 1e-2


def test_labellers_em_and_scores(spark):
    r = random.Random(9)
    prose = lambda n: " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) + ("." if r.random() < 0.1 else "") for _ in range(n))
    good = [prose(r.randint(60, 200)) for _ in range(300)]
    bad = [" ".join(w + "$$$" for w in prose(80).split()) for _ in range(20)] + [" ".join(["spam"] * 90 + ["eggs"] * 90) for _ in range(20)] + [prose(60).replace(" ", " | ") for _ in range(20)]
    docs = spark.createDataFrame([*enumerate(good + bad), (1000, None), (1001, "")], "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in quality.score(docs).collect()}
    assert len(found) == docs.count()
    assert sum(found[i].keep for i in range(300)) >= 297 and sum(found[i].keep for i in range(300, 360)) <= 6
    assert not found[1000].keep and found[1000].score == found[1001].score
    assert quality.score(docs.where("false")).count() == 0


def test_votes_of_one_text_do_not_depend_on_its_neighbours():
    import pyarrow as pa

    from vaultsieve.llm import hashing

    texts = ["a b a b\n\nx", "", "one two\none two\nthree", "é" * 50, "z " * 30]
    together = np.concatenate([v for _, _, v in quality.votes(pa.array(texts))])
    alone = np.concatenate([v for t in texts for _, _, v in quality.votes(pa.array([t]))])
    assert (together == alone).all() and hashing.SPACE.sum() == 6


def test_main_text():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header class="site-header">Brand</header><nav>menu</nav>
    <div class="content with-sidebar"><article><header><h1>Title</h1></header><p>One &amp; two<br>three <b>bo</b>ld<p>Next&nbsp;one
    <div class="ad-box">buy</div><aside>see</aside><script>if (a < b) document.write("</p>")</script><form><input>f</form><ul><li>i<li>j</ul>
    <section id="comments"><article><p>reader says</p></article></section><!-- x <p>y</p> --><footer>share</footer></article></div><footer>c</footer></body></html>"""
    assert html.blocks(page) == (["Title", "One & two three bold", "Next one", "i", "j"], True)
    assert html.blocks("") == ([], False) and html.blocks("<") == (["<"], False) and html.blocks("<p") == (["<p"], False)
    assert html.blocks("<div><article></article><p>x</p></div>") == ([], True)
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert html.blocks(deep) == (["x"], False)


def test_articles_of_other_roles_are_not_the_main_text(spark):
    text = "<div><p>" + "the main text in plain blocks " * 8 + "</p></div>"
    words = " ".join(("the main text in plain blocks " * 8).split())
    assert html.main_blocks(f'{text}<article class="comment"><p>reader</p></article>') == ([words], False)
    assert html.main_blocks(f'{text}<article class="card"><p>teaser</p></article>') == ([words, "teaser"], False)
    assert html.main_blocks(f"{text}<article></article>") == ([words], False)
    assert html.main_blocks(f"{text}<article><p>short</p></article>") == ([words, "short"], False)
    assert html.main_blocks('<p>a</p><article class="post category-social format-aside"><p>story</p></article>') == (["story"], True)
    for name in ("post-comments", "article-footer", "entry-share", "page-header", "main-menu", "content-ad", "content-sidebar"):
        assert html.main_blocks(f'<p>x</p><div class="{name}"><p>y</p></div>') == (["x"], False), name
    for name in ("content", "sidebar-content", "layout-with-sidebar", "has-sidebar", "main share"):
        assert html.main_blocks(f'<div class="{name}"><p>y</p></div>') == (["y"], False), name
    assert html.main_blocks("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x = 2</annotation></math> holds</p></article>") == (["so x=2 holds"], True)
    got = html.main_text(spark.createDataFrame([(1, "http://a/", f'{text}<article class="comment"><p>reader</p></article>')], "page_id long, url string, html string")).first()
    assert (got.text, got.n_chars) == (words, len(words))


def test_boilerplate_of_hosts_goes_and_copies_stay(spark):
    notice = "we keep crumbs of what you read here to make this place better for all of you"
    own = [f"<p>{notice}</p><p>story {i} about {i * 7} things</p>" for i in range(4)]
    copy = "<p>" + " ".join(f"w{i}" for i in range(40)) + "</p>"
    rows = [(i, f"http://one.example/{i}", h, "x") for i, h in enumerate(own)] + [(10 + i, "http://two.example/", copy, "x") for i in range(5)] + [(20, "http://three.example/", own[0], "x"), (21, None, None, "x"), (21, "bad url", "", "x")]
    found = {}
    for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect():
        found.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert [found[i] for i in range(4)] == [[f"story {i} about {i * 7} things"] for i in range(4)]
    assert all(found[10 + i][0].startswith("w0 w1") for i in range(5)) and found[20] == [f"{notice}\nstory 0 about 0 things"] and found[21] == ["", ""]
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_packing_is_a_round_trip(docs, rows, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    pieces = packing.pack(docs, tokenizer_path(), length=512, with_ids=True).collect()
    seen: dict[int, list] = {}
    for p in pieces:
        seen.setdefault(p.sequence_id, []).append(p)
    flat: list[int] = []
    for s in sorted(seen):
        at = 0
        for p in sorted(seen[s], key=lambda p: p.offset):
            ids = np.frombuffer(p.ids, "<u4").tolist()
            assert p.offset == at and len(ids) == p.length
            at += p.length
            flat += ids
        assert at == 512 or s == max(seen)
        assert seen[s][0].padded == (512 if s < max(seen) else max(1, 1 << (at - 1).bit_length()))
    want = sorted(tuple(whole.encode(t or "", add_special_tokens=False).ids) for _, t in rows)
    got, now = [], []
    for x in flat:
        if x == 2 and len(now) == 0 or x == 2:
            got.append(tuple(now))
            now = []
        else:
            now.append(x)
    assert sorted(got) == want
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_ids_of_words_are_ids_of_texts():
    from tokenizers import Tokenizer

    whole, ids = Tokenizer.from_file(tokenizer_path()), packing.WordIds(tokenizer_path())
    assert ids.direct
    r = random.Random(11)
    for _ in range(3000):
        text = "".join(r.choice("aBcé'ÜßÑŒ.,!-1İΣσ中<|>é  x") for _ in range(r.randint(0, 12)))
        assert np.frombuffer(b"".join(map(ids.__getitem__, text.encode().split())), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text
