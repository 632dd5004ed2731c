"""Row-wise corpus operators: exact round trips, brute force, and the awkward rows."""

import hashlib
import json
import pathlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fusionframe.llm import chat_format, html_extract, media, pii, queries, token_counts, toxicity

from ..conftest import same_rows

AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "é" * 70_000 + " end"), (5, "a b c"), (5, "a b c"), (None, "x y"), (7, "x")]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, a null id, and columns whose names clash."""
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    clash = ("n_bytes", "score", "key", "id", "class_id", "rep", "marks", "spans", "rate", "k", "row", "a", "b", "w")
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, data, duck, name):
    assert same_rows(queries.queries()[name](spark, data), duck, queries.oracle_sql()[name])


# --- chat ---


def chat(spark, rows):
    return chat_format.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("plain", F.lit(1)))


def test_chat_round_trip(spark):
    rng = random.Random(5)
    parts = ["<|im_end|>", "<|im_start|>", "<\\|", "<\\\\|x", "\n", "a", "\\", "|>", "<", "ß", "assistant\n"]
    rows = [(i, t, rng.choice(["user", "assistant", "a\nb", "r\\n", "<|im_end|>", "a\\\0b", "\\\\", "\\\n\\"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for i in range(150) for t in range(rng.randint(1, 4))]
    out = chat(spark, rows).withColumn("turns", chat_format.parse_chat(F.col("formatted"))).collect()
    want = {}
    for c, _, r, x in sorted(rows):
        want.setdefault(c, []).append((r, x))
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out} == want
    for r in out:
        assert r.formatted.count(chat_format.START) == r.n_turns == r.formatted.count(chat_format.END)
        loss = [re.sub(r"<\\(\\*)\|", r"<\1|", r.formatted[s.start : s.end]) for s in r.loss_spans]
        assert loss == [x for role, x in want[r.conv_id] if role == "assistant"]


def test_chat_awkward(spark):
    out = {r.conv_id: r for r in chat(spark, [(1, None, None, None), (1, 2, "user", "hi"), (1, 2, "user", "hi"), (None, 0, "assistant", "x" * 200_000)]).collect()}
    assert out[1].n_turns == 3 and out[1].formatted.startswith("<|im_start|>\n<|im_end|>\n") and out[1].n_escaped == 0
    assert len(out[None].formatted) > 200_000
    assert chat(spark, []).count() == 0


# --- pages ---


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""), ("", ""), ("<p>", ""), ("<nav>menu</nav>", ""),
        ("<article><h1>A &amp;amp; B</h1><p>x<b>y</b>  z<br>w</p><aside>no</aside><p>end.</p></article><footer>&copy;</footer>", "A &amp; B xy z w end."),
        ("<body><div class='sidebar'>s</div><main><p>one<p>two <i>three</i></main><div id=comments><p>me too</p></div>", "one two three"),
        ("<div class=cookie-notice>ok?</div><p>" + "word " * 40 + "</p><p>" + "more " * 40 + "</p><div><a href=x>l1</a> <a href=y>l2</a></div>", ("word " * 40 + "more " * 40).strip()),
        ("<article><p>a</p><script>if (a<b) '</p>'</script><style>p{}</style><!-- <p>c</p> --><form><input>f</form><p>b</p></article>", "a b"),
        ("<article><ul><li>1<li>2</ul><table><tr><td>3<td>4</table></article>", "1 2 3 4"),
        ("<article><p title='the hidden gem'>gem</p><p data-class='nav' alt=\"class='menu'\">kept</p><p hidden>h</p><p style='color:red; display : none'>h</p><p aria-hidden=true>h</p><p class='x nav'>n</p></article>", "gem kept"),
        ("<article><p>let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> be</p></article>", "let x=1 be".replace("x=1", "x=1 ").replace("1  be", "1 be")),
        ("<article>open <p>to the end &notanentity; &#65;", "open to the end &notanentity; A".replace("&not", "¬")),
    ],
)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


LONG_TEXT = "Long text here, of many words. " * 12
CARD = "<article><h3>Card</h3></article>"


def test_window_and_surge_decide():
    f = html_extract.main_text
    apart = f"<div><p>tiny</p></div><ul></ul><div></div><div><p>{LONG_TEXT}</p></div>"
    assert f(apart, 3, 86) == LONG_TEXT.strip() and f(apart, 9, 86) == f(apart, 1, 0) == "tiny " + LONG_TEXT.strip()
    assert f("<p>some words</p>" + "<section></section>" * 4 + "<p>and a few words more</p>", 3, 5) == "some words and a few words more"
    assert f("<p>some words</p>" + "<section></section>" * 4 + "<p>and a few words more</p>", 3, 12) == "and a few words more"
    cards = f"{CARD}<ul></ul><div></div><div><p>{LONG_TEXT}</p></div><ul></ul><div></div>{CARD}"  # landmarks around the text, not of it
    assert f(cards) == LONG_TEXT.strip()
    assert f(f"<p>An advert of some length that says nothing</p><article><h1>Title</h1><p>{LONG_TEXT}</p><div><div><div><p>End.</p></div></div></div></article>") == f"Title {LONG_TEXT}End."


def test_names_of_boilerplate():
    f = html_extract.main_text
    kept = '<article><p id="search-for-meaning">A</p><h2 class="related-work">B</h2>'
    assert f(kept + '<div class="x cookie-notice">C</div><div id="comments">D</div><span class="ad_box">E</span></article>') == "A B"
    assert f("<p>if a <b then stop") == "if a <b then stop"


@pytest.mark.parametrize("page", ["<b" * 50_000, "<div>" * 20_000 + "</p>" * 20_000, "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000, '<a x="' * 20_000, "<a '\"" * 20_000, "<!--" * 20_000, "<!" * 50_000, "<li><div>" * 10_000 + "<li>" * 10_000, "<div class=ad>" * 20_000 + "</div>" * 100, "<" * 100_000 + ">"])
def test_hostile_pages_are_quick(page):
    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 2


def test_pages_awkward(spark):
    df = spark.createDataFrame([(1, "u", None), (None, None, "<p>" + "<b>x" * 20_000), (2, "u", "<article>a</article>"), (2, "u", "<article>a</article>")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    rows = html_extract.extract_pages(df).collect()
    assert len(rows) == 4 and {r.page_id: r.n_chars for r in rows} == {1: 0, None: 20_000, 2: 1}
    assert html_extract.extract_pages(df.limit(0)).count() == 0


# --- tokens and media ---


def test_token_counts(spark, data, awkward, nothing):
    import public_tokenizers
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, "a  b " * 3000), (-2, "x▁y " * 4000 + " z"), (-3, "<s> </s>" * 2000), (-4, "\n \n" * 5000)], "doc_id long, text string")
    all_ = docs.union(odd)
    want = {r.doc_id: len(model.encode(r.text or "")) for r in all_.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(all_, path, batch_bytes=20_000).collect()} == want
    rows = token_counts.token_counts(awkward, path).collect()
    assert len(rows) == len(AWKWARD) and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    assert token_counts.token_counts(nothing, path).count() == 0


def test_media_round_trip(spark, awkward, nothing):
    rows = media.media_digest(media.text_to_media(awkward)).collect()
    want = {(i, hashlib.sha256(media.text_payload(x)[1]).hexdigest()) for i, x in AWKWARD}
    assert len(rows) == len(AWKWARD) and {(r.doc_id, r.payload_sha256) for r in rows} == want
    assert media.media_digest(media.text_to_media(nothing)).count() == 0
    packets = media.media_packets(media.text_to_media(awkward.where("doc_id = 4")))
    p = packets.orderBy("packet").collect()
    assert len(p) == -(-140_004 // 192) and all(b.byte_offset > a.byte_offset for a, b in zip(p, p[1:])) and {r.n_bytes for r in p} == {192}
    assert [r.timestamp_ns for r in p[:9]] == [0] * 8 + [8 * 24 * 10**6]


@pytest.mark.parametrize("kind", [media.XIPH, media.FIXED, media.EBML_LACE])
def test_lacing(kind):
    frames = [bytes([k]) * (300 if kind == media.FIXED else n) for k, n in enumerate((300, 255, 700, 1))]
    body = bytes([3]) + b"".join(frames) if kind == media.FIXED else media._laced(frames, kind)
    assert [body[a : a + n] for a, n in media._frames(body, 0, len(body), kind)] == frames


def test_unknown_sizes_and_groups():
    block = media.element(media.SIMPLE_BLOCK, b"\x81\x00\x05\x80abc")
    group = media.element(media.BLOCK_GROUP, media.element(media.BLOCK, b"\x82\xff\xff\x00de"))
    cluster = media.CLUSTER.to_bytes(4, "big") + b"\x01\xff\xff\xff\xff\xff\xff\xff" + media.element(media.CLUSTER_TIMESTAMP, b"\x0a") + block + group
    data = media.element(media.EBML, media.element(media.DOC_TYPE, b"webm")) + media.SEGMENT.to_bytes(4, "big") + b"\xff" + cluster + cluster
    m = media.parse_matroska(data)
    assert [(p.cluster, p.track, p.timestamp_ns, p.length) for p in m.packets] == [(0, 1, 15_000_000, 3), (0, 2, 9_000_000, 2), (1, 1, 15_000_000, 3), (1, 2, 9_000_000, 2)]


def test_broken_media(spark):
    good = media.write_matroska(b"x" * 4000)
    for cut in range(1, len(good), 97):
        try:
            media.parse_matroska(good[:cut])
        except media.MediaError:
            pass
    files = spark.createDataFrame([(1, bytearray(good[:200])), (2, None), (3, bytearray(b"no media"))], "file_id long, media binary")
    assert {r.file_id: r.error is not None for r in media.media_packets(files).collect()} == {1: True, 3: True}


# --- personal data ---


def brute_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]


def test_base_spans():
    rng = random.Random(3)
    for _ in range(20_000):
        s = "".join(rng.choice(["1", "25", "255", "0", ".", "-", " ", "+", "a", "@", "b.c", "(", ")", "%", "é", "4111111111111111"]) for _ in range(rng.randint(1, 24)))
        assert pii.base_spans(s) == brute_spans(s)


def test_tagger_on_held_out():
    """Recall of at least 0.9 of each kind, and as much precision, on texts of three seeds that it wasn't trained with."""
    for seed in (99, 100, 101):
        test = pii.labelled_windows(300, seed=seed)
        got = pii.added_spans([t for t, _ in test], [[] for _ in test], pii.default_tagger())
        for kind in range(len(pii.KINDS)):
            want = {(i, s) for i, (_, own) in enumerate(test) for s in own if s[0] == kind}
            found = {(i, s) for i, own in enumerate(got) for s in own if s[0] == kind}
            assert len(want & found) >= 0.9 * len(want) and len(want & found) >= 0.9 * len(found), (seed, pii.KINDS[kind])


def test_tagger_file():
    """The file is what queries use, rounded, and its training can go on: a few steps from the same seed lower the loss."""
    m = pii.default_tagger()
    held = json.loads((pathlib.Path(pii.__file__).parent / "pii_tagger.json").read_text())["weights"]
    assert held.keys() == pii.Tagger.fresh().p.keys()
    assert all((np.round(v, 4) == np.array(v)).all() and (m.p[k] == np.array(v, np.float32)).all() for k, v in held.items())
    examples = pii.labelled_windows(120, seed=1)
    few, more = pii.train(examples, 1), pii.train(examples, 25)
    ids = np.array([pii.symbols(t)[: pii.TRAINED] for t, _ in examples])
    y = np.zeros((pii.TRAINED, len(ids)), np.int64)
    for k, (_, spans) in enumerate(examples):
        for kind, a, b in spans:
            y[a : min(b, pii.TRAINED), k] = 2 + 2 * kind
            if a < pii.TRAINED:
                y[a, k] = 1 + 2 * kind
    loss = [pii.loss_and_gradient(t, ids, y)[0] for t in (few, more, m)]
    assert loss[0] > loss[1] > loss[2]
    assert all((a == b).all() for a, b in zip(pii.train(examples, 3).p.values(), pii.train(examples, 3).p.values()))


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(4)
    tagger = pii.Tagger.fresh(hidden=3, width=4)
    ids, y = rng.integers(0, pii.SYMBOLS, (5, 12)), np.zeros((12, 5), np.int64)
    y[3:6] = [[1], [2], [2]]
    y[8] = 5
    _, grads = pii.loss_and_gradient(tagger, ids, y)
    for name, v in tagger.p.items():
        for at in rng.integers(0, v.size, 12):
            held, step, got = v.flat[at], 1e-6, []
            for x in (held + step, held - step):
                v.flat[at] = x
                got.append(pii.loss_and_gradient(tagger, ids, y)[0])
            v.flat[at] = held
            assert abs((got[0] - got[1]) / (2 * step) - grads[name].flat[at]) < 1e-5 * max(1, abs(grads[name].flat[at])), name


def test_numbers_are_taken_whole():
    number = "2744757332971694"
    assert pii._whole_number(f"x {number} y", 2, 2, 17) == (2, 18) and pii._whole_number(f"x {number} y", 2, 5, 18) == (2, 18)
    assert pii._whole_number("4111 1111-1111 1111, 5", 2, 5, 14) == (0, 19)
    a, b = pii._whole_number("1" * 60, 2, 20, 36)
    assert b - a > 19 and not pii._plausible(2, "1" * (b - a))
    assert pii._whole_number("+4 (105) 557-8081", 3, 0, 15) == (0, 17)


def test_long_spelled_out_addresses():
    said = ["mariana.fernandezgonzalez (at) example-company (dot) com", "user.an (at) thesh (dot) example (dot) example.com", "inghaesther.thestionlichdean (at) shthehastion (dot) reationerlich (dot) example.com", "theationlyreha-shinglatistion [at] conthestinglich [dot] org"]
    texts = [f"Write to {x} today, es la the shan." for x in said] + ["the an er " * 40 + "x" * 30]
    got = pii.added_spans(texts, [[] for _ in texts], pii.default_tagger())
    for text, x, spans in zip(texts, said, got):
        at = text.index(x)
        assert [k for k, a, b in spans if a <= at and at + len(x) <= b < len(x) + at + 2] == [0]
    assert not got[-1]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(x for x, _ in pii.labelled_windows(n, seed=int(rng.integers(1 << 30))))


def test_tags_of_whole_texts():
    """Sums leave out nothing that the Viterbi pass over the whole text tags; what stands beside a text doesn't matter, nor its length."""
    m = pii.default_tagger()
    texts = [prose(1, 12), "", "x", prose(2, 1)[:30], prose(3, 9), "a" * pii.WINDOW, prose(4, 5)[: pii.WINDOW + 1]]
    lengths = np.array([len(x) for x in texts])
    ids = pii.symbols("".join(texts))
    got = np.zeros(len(ids), int)
    for a, tags in pii._tagged(ids, lengths, m):
        got[a : a + len(tags)] = tags
    start = np.cumsum(lengths) - lengths
    for x, a in zip(texts, start):
        if x:
            e = pii._scores(pii.symbols(x), np.array([len(x)]), m)
            assert (m.viterbi(e) == got[a : a + len(x)]).all()
    assert (got > 0).any()


def test_emissions_of_windows():
    """Each window gets what the training pass gives in float64, overlaps the weighted mean of both; any range is the same part of the whole."""
    m = pii.default_tagger()
    double = pii.Tagger({k: v.astype(float) for k, v in m.p.items()})
    over = pii.WINDOW - pii.STRIDE
    text = prose(7, 40)
    lengths = np.array([0, 1, over, pii.STRIDE, pii.WINDOW, 0, pii.WINDOW + 1, pii.WINDOW + pii.STRIDE, pii.WINDOW + pii.STRIDE + 1, 3000])
    want, at = [], 0
    for n in lengths:
        ids, e, k = pii.symbols(text[at : at + n]), np.zeros((n, pii.TAGS)), 0
        while n:
            own = ids[k : k + pii.WINDOW]
            last = k + pii.WINDOW >= n
            got = double.learn(np.append(own, np.zeros(int(last), own.dtype))[None])[0][: len(own), 0]
            share = np.clip((np.arange(len(own)) + 0.5) / over, 0, 1)[:, None] if k else 1
            e[k : k + len(own)] = share * got + (1 - share) * e[k : k + len(own)]
            if last:
                break
            k += pii.STRIDE
        want.append(e)
        at += n
    want, ids = np.concatenate(want), pii.symbols(text[:at])
    e = pii._Emissions(ids, lengths, m)
    whole = pii._scores(ids, lengths, m)
    assert e.size == len(ids) == at and np.abs(whole - want).max() < 1e-3
    assert (e.lead == whole[:, 1:].max(1) - whole[:, 0]).all()
    rng = random.Random(2)
    for _ in range(200):
        a = rng.randrange(at)
        b = rng.randint(a + 1, min(at, a + rng.choice([3, 60, 1500])))
        assert (e.rows(a, b) == whole[a:b]).all()


def test_tagger_costs_less_than_the_plain_form():
    """All of tagging takes well less CPU time than the network alone in its plain form, which keeps all states and clips twice."""
    m, n, windows = pii.default_tagger(), pii.WINDOW, 1024
    rng = random.Random(9)
    words = "harbour lantern quartz willow meadow copper justice orchestra twelve people walked along Müller straße niño garçon below".split()
    ids = pii.symbols(" ".join(rng.choice(words) for _ in range(n * windows // 4))[: n * windows])
    lengths = np.full(windows, n)

    def plain():
        steps, total = np.vstack((ids.reshape(windows, n).T, np.zeros((1, windows), np.uint8))), 0
        for d, rows, order in (("f", slice(None, 10), range(n + 1)), ("b", slice(10, None), range(n, -1, -1))):
            table, wh = (m.p["emb"] @ m.p[f"wx{d}"] + m.p[f"b{d}"]).T.copy(), m.p[f"wh{d}"].T.copy()
            table[:30], wh[:30] = 0.25 * table[:30] + 0.5, 0.25 * wh[:30]
            out, h, c = np.empty((n + 1, 10, windows), np.float32), np.zeros((10, windows), np.float32), np.zeros((10, windows), np.float32)
            for t in order:
                z = np.matmul(wh, h)
                z += np.take(table, steps[t], axis=1)
                np.minimum(z, 1, out=z)
                np.maximum(z[:30], 0, out=z[:30])
                np.maximum(z[30:], -1, out=z[30:])
                c *= z[10:20]
                c += z[:10] * z[30:]
                h = out[t]
                np.minimum(np.maximum(c, -1), 1, out=h)
                h *= z[20:30]
            total = total + np.matmul(m.p["out"][rows].T.copy(), out)
        return (total.transpose(2, 0, 1)[:, :n] + m.p["ob"]).reshape(-1, pii.TAGS)

    assert np.abs(plain() - pii._scores(ids, lengths, m)).max() < 1e-3
    took = {plain: [], pii._tagged: []}
    for _ in range(5):
        for f, own in took.items():
            t = time.thread_time()
            f(*([ids, lengths, m] if f is pii._tagged else []))
            own.append(time.thread_time() - t)
    assert min(took[pii._tagged]) < 0.85 * min(took[plain]), took


def test_very_long_text(monkeypatch):
    """A text over LONG is scored in parts with the same result."""
    m, text = pii.default_tagger(), prose(6, 60)
    whole = pii.tagger_spans([text], m)
    assert whole[0]
    for limit in (pii.STRIDE, 3 * pii.STRIDE + 5):
        monkeypatch.setattr(pii, "LONG", limit)
        assert pii.tagger_spans([text], m) == whole


def test_plain_prose_has_no_spans():
    """The tagger itself, without the check of what a kind needs: prose of other words than it was trained with."""
    words = "harbour lantern quartz willow meadow copper justice orchestra twelve hundred people walked along Müller straße niño garçon 42 2019 (see below) Mr. Smith's".split()
    rng = random.Random(9)
    texts = [" ".join(rng.choice(words) for _ in range(300)) + "." for _ in range(40)]
    assert sum(map(len, pii.tagger_spans(texts, pii.default_tagger()))) <= 2


def test_pii_awkward(spark, awkward, nothing):
    rows = pii.find_pii(awkward, redact=True, keep=["doc_id", "text", "key"]).collect()
    assert len(rows) == len(AWKWARD) and all(r.redacted == r.text and not r.spans for r in rows)
    assert pii.find_pii(nothing).count() == 0
    df = spark.createDataFrame([(1, "mail é.a@b.co or +1 (811) 555-3281")], "doc_id long, text string")
    assert pii.find_pii(df, redact=True).first().redacted == "mail é<EMAIL> or <PHONE>"


# --- toxicity ---


def test_toxicity_learns(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(900):
        y = int(rng.random() < 0.3)
        text = [rng.choice(words) for _ in range(40)] + [rng.choice(["vile", "awful", "nasty"])] * y
        rng.shuffle(text)
        docs.append((i, " ".join(text)))
        labels.append((i, y))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit_toxicity(d, lab)
    y = dict(labels)
    rows = [r for r in toxicity.score_toxicity(d, model).collect() if __import__("zlib").crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.predicted == y[r.doc_id] for r in rows]) > 0.97 and len(model.buckets) < 5000
    assert toxicity.fit_toxicity(d, lab.limit(0)) is None


def test_toxicity_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(5, 1), (5, None), (None, 1), (7, 0), (4, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(awkward, labels)
    rows = toxicity.score_toxicity(awkward, model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in toxicity.score_toxicity(awkward, None).collect()} == {0.0}
    assert toxicity.score_toxicity(nothing, model).count() == 0
