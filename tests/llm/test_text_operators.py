"""Operators that handle each document alone: exact results, edge cases, extra columns."""

import functools
import hashlib
import os
import random
import re

import numpy as np
import pytest
from trackloom.llm import bpe, html_text, pii, quality_qda, quality_rules

EDGES = [(1, None), (2, ""), (3, "  \n\t "), (4, "word"), (4, "word"), (None, "no id here"), (5, "x" * 50_000), (6, "a b c d e " * 3_000), (7, "né 中文 😀\x85 x")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, "clash") for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


# -- tokens


@functools.lru_cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def check_tokens(texts):
    tokenizer = bpe.ByteBpe(open(bpe.default_path(), "rb").read())
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0] + [len(x) for x in raw])
    ids, counts = tokenizer.encode(np.frombuffer(b"".join(raw), np.uint8), bounds)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    want = library().encode_batch(texts, add_special_tokens=False)
    for i, e in enumerate(want):
        assert ids[cuts[i] : cuts[i + 1]].tolist() == e.ids, texts[i]
    decoded = [x.decode() for x in tokenizer.decode(ids, counts)]
    assert decoded == [library().decode(e.ids, skip_special_tokens=False) for e in want]


def test_tokens_equal_the_library():
    check_tokens(["", "hello world", "don't we'll I'VE 's ''s 'sx  's", "  \n\n a\t b  ", "<|endoftext|> x<|endoftext|><|endoftext|>", "a" * 3000, "中文 ünï 😀😀", "\x85 x\xa0y 12³ ½", "'", "it's's"])


def test_tokens_equal_the_library_on_random_texts():
    rng = random.Random(5)
    alphabet = "aabcdest'rvlm  \n\téñ0123!?.,-_😀中ſ\x85\x1c" + "RE"
    check_tokens(["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(3000)])


def test_shared_prefixes_give_the_same_as_single_words():
    tokenizer = bpe.ByteBpe(open(bpe.default_path(), "rb").read())
    words = [b" internationalisation", b" international", b" inter", b" interna", b"zzzqqq", b" " * 9]
    together = tokenizer.walk(words)
    assert together == [tokenizer.walk([w])[0] for w in words]


def test_encode_documents(spark, docs):
    rows = bpe.encode_documents(docs, with_text=True).collect()
    assert len(rows) == len(EDGES)
    by_text = {r.decoded: r for r in rows}
    for _, t in EDGES:
        r = by_text[t or ""]
        ids = library().encode(t or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(empty(spark)).count() == 0


# -- personal data


def brute_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [
        [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))],
        [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and pii._luhn(digits(m[0]))],
        [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15],
    ]
    return found


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("aA1@.-+ ()0259_%\n") for _ in range(50))
        assert pii.base_spans(t) == brute_base(t), t
    for t in ("a@b.c_d@e.f g@h", "999.1.1.1 1.2.3.4.5.6.7.8", "4111 1111-1111 1111", "+1 (988) 555-2485", "é a.b+c@x-y.co.uk!"):
        assert pii.base_spans(t) == brute_base(t)


def test_long_runs_are_linear():
    assert pii.base_spans("1" * 300_000) == [[], [], [], []]
    assert pii.base_spans("a" * 300_000 + "@") == [[], [], [], []]
    assert pii.base_spans("+" * 100_000 + "1." * 100_000)[0] == []


def test_added_spans(spark):
    text = "call +1 (269) 555-3296 4524132264652876 now, write to jane.roe [at] example [dot] org, phone: (415) 555-2671; order 123-456 of version 1.2"
    row = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string"), redact=True).first()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (0, 0, 0, 0) or row.n_phone == 1
    kinds = {s.split(":")[0]: tuple(map(int, s.split(":")[1:])) for s in row.spans.split(",")}
    assert text[slice(*kinds["email"])] == "jane.roe [at] example [dot] org"
    assert text[slice(*kinds["card"])] == "4524132264652876"
    assert "[EMAIL]" in row.redacted and "4524132264652876" not in row.redacted and "order 123-456 of version 1.2" in row.redacted


def test_calibration_finds_the_least_certain_score():
    rng = np.random.default_rng(2)
    scores = rng.random(20_000)
    truth = (rng.random(20_000) < scores**2).astype(float)
    assert abs(pii.least_certain(scores, truth, 0.6) - 0.6**0.5) < 0.03
    assert pii.least_certain(scores, np.zeros(20_000), 0.6) == 2.0 and pii.least_certain(scores[:0], truth[:0], 0.6) == 2.0


def other_data(rng):
    """Text of another make than the training examples: (text, kind, span) of personal data, or (text, None, None)."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice("bdfgklmnprstvaeiou") for _ in range(rng.randint(3, 9)))
    kind = rng.randrange(5)
    if kind == 0:
        span = rng.choice([f"{w()}.{w()} at {w()} dot {w()} dot org", f"{w()}[at]{w()}[dot]net", f"{w()}{d(2)} (at) {w()} (dot) com"])
        return f"Please write to {span} if {w()}", 0, span
    if kind == 1:
        span = rng.choice([".", "[.]", "(.)"]).join(str(rng.randrange(256)) for _ in range(4)).replace(".", "[.]", 1).replace("[[.]]", "[.]").replace("([.])", "(.)")
        return f"the server {span} was {w()}", 1, span
    if kind == 2:
        body = rng.choice("45") + d(14)
        body += next(c for c in "0123456789" if pii._luhn(body + c))
        span = rng.choice(["/", ".", "_"]).join(body[i : i + 4] for i in (0, 4, 8, 12))
        return f"paid by credit card {span} on {w()}", 2, span
    if kind == 3:
        span = rng.choice([f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)}/{d(6)}", f"({d(3)}) {d(3)}-{d(4)}", f"0{rng.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"00{d(2)} {d(2)} {d(6)}"])
        return f"you may call {span} from {w()} on", 3, span
    return rng.choice([f"order {d(3)}-{d(3)}-{d(4)} of {w()}", f"in the year {rng.randint(1900, 2020)}-{rng.randint(1900, 2020)} {w()}", f"see section {d(1)}.{d(1)}.{d(2)} at {w()}", f"at {rng.randint(0, 23)}:{d(2)}:{d(2)} {w()} came", f"price {d(1)} {d(3)} {d(3)} {w()}", f"arrived at {w()}. Then {w()}"]), None, None


def test_added_spans_on_other_data():
    rng = random.Random(31)
    model, limits = pii.trained()
    assert len(set(limits)) == 4 and max(limits) - min(limits) > 0.1
    found, of, wrong, clean = [0] * 4, [0] * 4, 0, 0
    for _ in range(3000):
        text, kind, span = other_data(rng)
        base = pii.base_spans(text)
        got = {(k, text[a:b]) for k, a, b in pii._added([text], [base], model, limits)[0]} | {(k, text[a:b]) for k, v in enumerate(base) for a, b in v}
        if kind is None:
            clean, wrong = clean + 1, wrong + bool(got)
        else:
            of[kind], found[kind] = of[kind] + 1, found[kind] + ((kind, span) in got)
    assert all(f >= 0.85 * n for f, n in zip(found, of)), (found, of)
    assert wrong <= 0.05 * clean


def test_no_single_feature_tells_the_examples_apart():
    rng = random.Random(4)
    rows = [r for _ in range(2500) for r in pii._labelled(rng)]
    x, y = np.array([pii.features(*r[:4]) for r in rows], float), np.array([r[4] for r in rows])
    for kind in range(4):
        own = x[:, 0] == kind
        for j in range(1, x.shape[1]):
            value = x[own, j]
            best = max(max(np.mean((value <= c) == y[own]), np.mean((value > c) == y[own])) for c in np.unique(value)[:-1]) if len(np.unique(value)) > 1 else 0
            assert best < 0.97, (kind, j, best)


def test_added_spans_equal_brute_force():
    rng = random.Random(12)
    separator = re.compile(r" ?[().\-/_] ?\(?| \(?")

    def brute_numbers(text):
        out = set()
        edges = [m.span() for m in re.finditer("[0-9]+", text)]
        for i in range(len(edges)):
            for j in range(i, len(edges)):
                if all(separator.fullmatch(text[edges[k][1] : edges[k + 1][0]]) for k in range(i, j)):
                    a, b = edges[i][0], edges[j][1]
                    n = len(re.sub("[^0-9]", "", text[a:b]))
                    if 7 <= n <= 15:
                        out.add((3, a - (text[a - 1 : a] == "(" and ")" in text[a:b]), b))
                    if 13 <= n <= 19:
                        out.add((2, a, b))
        return out

    def brute_emails(text):
        out = set()
        dot = r"(?:\.| +dot +| *[\[({] *(?:dot|\.) *[\])}] *)"
        for i in range(1, len(text)):
            m = re.compile(r" *[\[({] *at *[\])}] *| +at +| *@ *", re.I).match(text, i)
            local = re.search(r"[A-Za-z0-9._%+-]+$", text[:i])
            host = re.match(rf"[A-Za-z0-9-]+(?:{dot}[A-Za-z0-9-]+)+", text[m.end() :], re.I) if m else None
            if local and host:
                out.add((0, local.start(), m.end() + host.end()))
        return out

    for _ in range(4000):
        text = "".join(rng.choice(["12", "345", "6789", " ", "-", ".", "(", ")", "/", "a", "bc", " at ", "[at]", " dot ", "[.]", "@", " x "]) for _ in range(14))
        got = pii.candidates(text)
        assert got == sorted(got)
        assert {c for c in got if c[0] > 1} == brute_numbers(text), text
        assert {c for c in got if c[0] == 0} == brute_emails(text), text
        base = [sorted((a, min(len(text), a + rng.randint(1, 6))) for a in rng.sample(range(len(text)), 2)) if text and rng.random() < 0.3 and len(text) > 2 else [] for _ in range(4)]
        assert pii._clear(got, base) == [c for c in got if not any(c[1] < b and a < c[2] for spans in base for a, b in spans)]
        scored = [(rng.randrange(5) / 5, *c) for c in got]
        taken = []
        for _, k, a, b in sorted(scored, key=lambda c: (-c[0], c[2], -c[3], c[1])):
            if not any(a < d and c < b for _, c, d in taken):
                taken.append((k, a, b))
        assert sorted(pii.choose(scored)) == sorted(taken)


def test_long_texts_with_many_candidates(spark):
    unit = "call 020 7946 0958 or write to jane at mail dot example dot com about 4111.1111.1111.1111; " + "plain words go on here and there " * 60
    text = unit * (5_000_000 // len(unit))
    row = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    spans = [s.split(":") for s in row.spans.split(",")]
    assert len(spans) == 3 * text.count("call 020")
    assert {text[int(a) : int(b)] for _, a, b in spans} == {"020 7946 0958", "jane at mail dot example dot com", "4111.1111.1111.1111"}
    lone = "x" * 200 + " at mail dot com"
    assert pii._added([lone], [pii.base_spans(lone)], *pii.trained()) == [[(0, 0, len(lone))]]


def test_personal_data_edges(spark, docs):
    rows = pii.find_personal_data(docs).collect()
    assert len(rows) == len(EDGES)
    nothing = hashlib.sha256(b"").hexdigest()
    assert all(r.base_sha256 == nothing and r.spans == "" and r.n_email + r.n_ip + r.n_card + r.n_phone == 0 for r in rows)
    assert pii.find_personal_data(empty(spark)).count() == 0


# -- quality rules


def brute_repeat_words(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for i, g in enumerate(grams):
        seen.setdefault(g, []).append(i)
    return len({p + k for places in seen.values() if len(places) > 1 for p in places for k in range(5)})


def test_quality_measures_equal_brute_force(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "b", "c#", "dd\n", "é"]) for _ in range(rng.randrange(60))) for _ in range(300)] + ["", "x", " a  b ", "l\nl\n \nl"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.judge(df).collect():
        t = texts[r.doc_id]
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == brute_repeat_words(t)
        assert r.base_failed == (len(words) < 10 or 100 * r.n_repeat_words > 20 * len(words))
        assert not (r.base_failed and r.kept)


def test_quality_edges(spark, docs):
    kept = {r.doc_id for r in quality_rules.keep_good(docs).collect()}
    assert kept == set()
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.judge(empty(spark)).count() == 0
    good = "The cat sat on the mat and looked at the moon, which was full and bright that night over the hills."
    one = spark.createDataFrame([(1, good, "x")], "doc_id long, text string, kept string")
    assert quality_rules.keep_good(one).collect() == one.collect()


# -- quality classifier


def test_classifier_separates_and_ignores_held_out_labels(spark):
    rng = random.Random(1)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(60)) + "."
    bad = lambda: " ".join([rng.choice(["buy!!", "CLICK###"])] * 30 + ["now"] * 30)
    rows = [(i, good() if i % 2 else bad()) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality_qda.score_documents(docs, labels).collect()}
    import zlib

    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(400))
    held = [r for r in found.values() if r.held_out]
    assert sum(r.predicted == r.doc_id % 2 for r in held) >= 0.95 * len(held)
    # the labels of held-out rows change nothing
    turned = spark.createDataFrame([(i, 1 - i % 2 if found[i].held_out else i % 2) for i in range(400)], "doc_id long, quality int")
    again = {r.doc_id: r.score for r in quality_qda.score_documents(docs, turned).collect()}
    assert all(abs(again[i] - found[i].score) < 1e-9 for i in range(400))


def test_moments_and_scores_equal_brute_force(spark):
    """Against two Gaussian densities written out with inverse and determinant, from rows in another order and number of parts."""
    rng = np.random.default_rng(6)
    m = len(quality_qda.FEATURES)
    x = np.rint(rng.gamma(2.0, 1.0, (900, m)) * quality_qda.STEPS) / quality_qda.STEPS
    y = (x[:, 0] + x[:, 3] * x[:, 5] > 4).astype(int)
    fold = rng.integers(0, 2, 900) * quality_qda.TUNING
    rows = [(r.tolist(), int(c), int(f)) for r, c, f in zip(x, y, fold)]
    df = spark.createDataFrame(rows, "x array<double>, y long, fold int")
    moments = quality_qda.class_moments(df.repartition(7))
    assert all((a == b).all() for a, b in zip(moments.values(), quality_qda.class_moments(df.orderBy("y").coalesce(2)).values()))
    for (c, t), s in moments.items():
        own = np.hstack([np.ones((900, 1)), x])[(y == c) & ((fold == quality_qda.TUNING) == t)]
        assert np.abs(s - own.T @ own).max() < 1e-6
    model = quality_qda.Discriminant.fit([moments[c, False] + moments[c, True] for c in (0, 1)], 0.3)
    spread = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    n = [(y == c).sum() for c in (0, 1)]
    pooled = (n[0] * spread[0] + n[1] * spread[1]) / 900
    densities = []
    for c in (0, 1):
        cov = (1 - quality_qda.RIDGE) * (0.7 * spread[c] + 0.3 * pooled) + quality_qda.RIDGE * np.eye(m) * np.trace(pooled) / m
        away = x - x[y == c].mean(axis=0)
        densities.append(-0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(n[c] / 900))
    assert np.abs(model.margin(x) - (densities[1] - densities[0])).max() < 1e-4


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are not here")
def test_held_out_labels_are_met(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in quality_qda.query(spark, "/root/testdata/sf0.01").collect() if r.held_out and labels.get(r.doc_id) in (0, 1)]
    assert len(rows) > 50 and sum(r.predicted == labels[r.doc_id] for r in rows) >= 0.95 * len(rows)


def test_classifier_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 7)], "doc_id long, quality int")
    rows = quality_qda.score_documents(docs, labels).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    assert quality_qda.score_documents(empty(spark), labels).count() == 0


# -- html


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<div class="cookie-notice">We use cookies, please accept all of them now</div><header><h2>Site name</h2></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav><!-- ad 1 -->
<%s><h1>Title &amp; words</h1><p><b>First   para<br>goes on and on with many plain words in it</p><p>a<i>b</i> c&nbsp;d</p><div class="ad">buy this now</div><p>End.</p></%s>
<div id="comments"><p>A very long reader comment that goes on and on with many words and words and more words than the text.</p></div>
<aside>Sidebar text long enough to count</aside><form><p>Your name please</p><button>Send</button></form><footer>&copy; foot</footer></body></html>"""


@pytest.mark.parametrize("holder", ["article", "main", "div", "section"])
def test_main_text(holder):
    want = "Title & words\nFirst para goes on and on with many plain words in it\nab c d\nEnd."
    assert html_text.Page(PAGE % (holder, holder)).main_text(html_text.trained()) == want


def test_html_edges(spark):
    odd = [None, "", "<", "<p", "<script>var a", "<!-- c", "plain text", "a < b <i>c</i>", '<a title="x>y">k</a> word word', "<p>x<p>y</div></p>z"]
    df = spark.createDataFrame([(i, None, h, "clash") for i, h in enumerate(odd)], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_text(df).collect()}
    want = ["", "", "<", "", "", "", "plain text", "a < b c", "k word word", "x\ny\nz"]
    assert [got[i][0] if i != 3 else "" for i in range(len(odd))] == want
    assert all(n == len(t) for t, n in got.values())
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_long_pages_are_linear():
    w = html_text.trained()
    for source in ("<p>x" * 50_000, '<a "' * 50_000, "<div>" * 50_000 + "w", "</div>" * 50_000 + "w"):
        html_text.Page(source).main_text(w)
