"""The training-data operators on small tables: edge cases, exact twins and round trips."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

pytest.importorskip("adtflow.llm")

from adtflow.llm import bpe, classifier, components, decontamination, html_text, jaccard, licenses, media, pii, sharding, warc  # noqa: E402
from adtflow.llm.pii_model import labelled_text, symbols, tag_spans, trained  # noqa: E402
from tests_llm_helpers import components_of, edited, words  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, h string, r string"


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, None, "s", None, "x", "y", "z", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n\t", "a", "A a", "Straße 😀 naïve", "x" * 5000, "w " * 3000, "w " * 3000]


# 1
@pytest.mark.parametrize("n_shards", [1, 7, 40])
def test_shards_are_contiguous_and_balanced(spark, n_shards):
    r = random.Random(1)
    texts = [words(r, r.randint(0, 300)) for _ in range(400)] + ODD
    got = sorted((tuple(x) for x in sharding.shard_by_bytes(docs(spark, texts), n_shards).collect()))
    sizes = [len((t or "").encode()) + 16 for t in texts]
    assert [x[1] for x in got] == sizes
    assert [x[2] for x in got] == [zlib.crc32((t or "").encode()) for t in texts]
    assert [x[4] for x in got] == sorted(x[4] for x in got) and got[-1][4] < n_shards
    start, slots = 0, collections.Counter()
    for _, size, _, law, shard, slot, grown in got:
        assert shard == (2 * start + size) * n_shards // (2 * sum(sizes)) and slot == slots[shard] and law == "bytes" and grown is None
        slots[shard] += 1
        start += size


def test_shards_of_null_and_repeated_ids_and_of_nothing(spark):
    got = sharding.shard_by_bytes(docs(spark, ["same"] * 300 + [None] * 100, [None] * 200 + [5] * 200), 4).collect()
    assert len(got) == 400
    for s in range(4):
        assert sorted(x["slot"] for x in got if x["shard"] == s) == list(range(sum(x["shard"] == s for x in got)))
    assert sharding.shard_by_bytes(docs(spark, []), 4).collect() == []


# 2
PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>site</header><nav><ul><li><a>menu</a></ul></nav>
<div class="ad">buy<article><h1>Head &amp; more</h1><p>One <b>two</b>three<br>four&nbsp;five<p>six &lt;b&gt;<ul><li>x<li>y</ul>
<div class="comments"><article class="comment">reader</article></div><form>mail</form></article><footer>foot</footer><script>if (a<b) {}</script>"""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string")


def test_article_text(spark):
    rows = [(i, f"http://h/{i}", PAGE, "x", "y") for i in range(3)] + [(None, None, None, None, None), (4, "", "", None, None), (5, "http://h/5", "plain <nav>n</nav> text", None, None)]
    got = {x["page_id"]: x for x in html_text.main_texts(pages(spark, rows)).collect()}
    assert got[0]["text"] == "Head & more One twothree four five six <b> x y" and got[0]["n_chars"] == len(got[0]["text"])
    assert got[None]["text"] == "" and got[4]["text"] == "" and got[5]["text"] == "plain text"
    assert html_text.main_texts(pages(spark, [])).collect() == []


def test_style_tree_removes_what_a_host_repeats(spark):
    r = random.Random(2)
    rows = [(i, f"http://h.org/{i}", f'<body><div class="welcome">Welcome to our site</div><div class="prose">{words(r, 30)}</div>', None, None) for i in range(20)]
    got = html_text.main_texts(pages(spark, rows)).collect()
    assert all("Welcome" not in x["text"] and len(x["text"]) > 30 for x in got)


def test_copies_of_a_page_keep_their_text(spark):
    rows = [(i, f"http://c.org/{i}", '<body><div class="main">The same words on every page</div><nav>n</nav>', None, None) for i in range(20)]
    assert {x["text"] for x in html_text.main_texts(pages(spark, rows)).collect()} == {"The same words on every page"}


def test_text_after_raw_elements_stays():
    text = lambda x: html_text.Page(x).main_text(set())
    assert text("<body><p>" + "İ" * 9 + "</p><script>s</script><p>first words</p><STYLE>x</Style ><p>second</p>") == "İ" * 9 + " first words second"
    assert text("<head><title>İİİ</title><body><p>start of it</p>") == "start of it"
    for tag in sorted(html_text.RAW - html_text.TO_THE_END):
        assert text(f"<body><p>one</p><{tag}><p>two</p>") == "one two", tag
    for tag in sorted(html_text.RAW - {"head"}):
        assert text(f"<body><p>one</p><{tag}>x</{tag.upper()}\n><p>two</p>") == "one two", tag
    for tag in sorted(html_text.TO_THE_END):
        assert text(f"<body><p>one</p><{tag}><p>two</p>") == "one", tag
    assert text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> be</p></article>") == "Let x = 2 be"


def test_an_article_does_not_decide_for_the_whole_page(spark):
    r = random.Random(17)
    main = [words(r, 30) for _ in range(3)]
    teaser = '<div class="related"><article>teaser</article></div>'
    rows = [(0, "http://a/0", f'<body><div class="content">{main[0]}</div>{teaser}', None, None), (1, "http://b/1", f"<body><p>{main[1]}</p><main>more</main>", None, None)]
    rows += [(2, "http://c/2", f'<body><div class="ad">buy<article>{main[2]}</article><script>"</div>"</script>', None, None)]  # never closed
    got = {x["page_id"]: x["text"] for x in html_text.main_texts(pages(spark, rows)).collect()}
    assert got == {0: main[0], 1: main[1] + " more", 2: main[2]}


def test_entropy_decides_on_small_hosts(spark):
    r = random.Random(18)
    rows, want = [], {}
    for n in range(1, 8):
        for i in range(n):
            main = words(r, 30)
            rows.append((100 * n + i, f"http://h{n}/{i}", f'<body><div class="welcome">Welcome to us</div><div class="prose">{main}</div>', None, None))
            want[100 * n + i] = main if n > 1 else "Welcome to us " + main
    for i in range(4):  # copies of a page beside another one
        main = "another" if i == 3 else "the same words"
        rows.append((i, f"http://copies/{i}", f'<body><div class="{"x" if i == 3 else "y"}">{main}</div>', None, None))
        want[i] = main
    assert {x["page_id"]: x["text"] for x in html_text.main_texts(pages(spark, rows)).collect()} == want


# 3
def test_classifier_learns_and_scores_alike(spark):
    r = random.Random(3)
    good = [words(r, r.randint(20, 80)) for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in words(r, 40).split()) for _ in range(75)] + [" ".join([w] * 9) for w in ("abc", "ananer", "edou") * 25]
    texts, y = good + bad, [1] * len(good) + [0] * len(bad)
    d = docs(spark, texts + ODD)
    labels = spark.createDataFrame([(i, v, 0) for i, v in enumerate(y)] + [(None, 1, 0), (99999, 0, 0)], "doc_id long, quality int, toxic int")
    model = classifier.fit(d, labels, "quality")
    got = {x["doc_id"]: x["score"] for x in classifier.score(d, model).collect()}
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.3) == y[i] for i in held) / len(held) > 0.95
    n = len(texts)
    assert got[n] == got[n + 1] == got[n + 2] and got[n + 7] == got[n + 8] and all(0 <= s <= 1 for s in got.values())
    kept = classifier.keep_scored(d, model, 0.3)
    assert kept.schema.names == d.schema.names and kept.count() == sum(s >= 0.3 for s in got.values())
    assert classifier.score(docs(spark, []), model).collect() == []
    assert classifier.train([], []).score(["a", None])[0] == 0.5


def test_long_texts_have_the_features_of_their_whole():
    text = words(random.Random(4), 3000)
    whole = classifier.train([text, text.upper()], [1, 0]).score([text])[0]
    size = classifier.CHUNK
    try:
        model = classifier.train([text, text.upper()], [1, 0])
        classifier.CHUNK = 1000
        assert abs(model.score([text])[0] - whole) < 1e-9
    finally:
        classifier.CHUNK = size


# 4
def test_bpe_equals_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library, r = Tokenizer.from_file(path), random.Random(5)
    texts = [x or "" for x in ODD] + [words(r, 200) for _ in range(20)] + ["".join(chr(r.randrange(1, 0x2FFF)) for _ in range(99)) for _ in range(40)]
    texts += ["a<|endoftext|>b <|endoftext|>", "<|endoftext|>", "aaaaaaa" * 9, "  \n\n  x  ", "don't we'll I'M"]
    own = bpe.codec(open(path, encoding="utf-8").read())
    got = {x["doc_id"]: x for x in bpe.bpe_round_trip(docs(spark, texts), path).collect()}
    for i, (t, e) in enumerate(zip(texts, library.encode_batch(texts, add_special_tokens=False))):
        assert own.encode(t) == e.ids and own.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(e.ids) and got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, e.ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.bpe_round_trip(docs(spark, [None]), path).first()["n_tokens"] == 0


# 5
def test_licenses(spark):
    r = random.Random(6)
    texts = [words(r, 40) + "\nReleased under the MIT License.\n" + words(r, 30), words(r, 100), licenses.NOTICES["ISC"], "This work is licensed under CC BY-NC 4.0", *ODD]
    got = {(x["doc_id"], x["license"]) for x in licenses.license_matches(docs(spark, texts)).collect()}
    assert got == {(0, "MIT"), (2, "ISC"), (3, "CC-BY-NC-4.0")}
    whole = licenses.scanner()
    for t in texts[:4]:  # against every window of every template's size
        b = licenses.bigrams(t).tolist()
        best = max((licenses.dice(set(b[i : i + n]), s) for s, n in zip(whole.sets, whole.lengths) for i in range(max(0, len(b) - n) + 1)), default=0)
        assert bool(whole.scan(t)) == (best >= licenses.THRESHOLD)


def test_edited_notices_match_as_brute_force_says():
    r = random.Random(16)
    notice = licenses.NOTICES["MIT"].split()
    marked = [" ".join(w if i % n else f"dnl {w}" for i, w in enumerate(notice)) for n in (12, 14, 20)]
    split = [" ".join([*notice[:40], *words(r, n).split(), *notice[40:]]) for n in (5, 22, 60)]
    moved = [" ".join([*words(r, 9).split(), *notice[45:], *notice[:45], *words(r, 9).split()]), " ".join(notice[:60]), " ".join(notice[:50])]
    for name in ("ISC", "MPL-2.0"):
        moved += [words(r, 12) + " " + edited(r, licenses.NOTICES[name], n) for n in (1, 2, 4, 8)]
    twice = [" ".join(notice) + " " + licenses.NOTICES["ISC"], "licensed under MIT " * 50, "REM " * 30 + marked[0].replace("dnl", "REM REM REM REM")]
    s = licenses.scanner()
    templates = sorted(set(zip(map(frozenset, s.sets), s.licenses, strict=True)), key=lambda x: len(x[0]))
    found = 0
    for text in marked + split + moved + twice:
        b = licenses.bigrams(text).tolist()
        best = 0.0
        for t, _ in templates:
            for i in range(len(b)):
                seen = set()
                shared = 0
                for h in b[i:]:
                    if h not in seen:
                        seen.add(h)
                        shared += h in t
                    best = max(best, 2 * shared / (len(seen) + len(t)))
        got = s.scan(text)
        assert bool(got) == (best >= licenses.THRESHOLD) and max((x.score for x in got), default=0) == (round(best, 6) if got else 0)
        found += bool(got)
    assert found >= 8 and [x.license for x in s.scan(twice[0])] == ["MIT", "ISC"] and all([x.license for x in s.scan(x)] == ["MIT"] for x in [*marked, split[1]])


# 6
def test_media_round_trip(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"".join(len(d).to_bytes(4, "big") + n + d + zlib.crc32(n + d).to_bytes(4, "big") for n, d in ((b"IHDR", bytes(13)), (b"IEND", b"")))
    got = {x["doc_id"]: x for x in media.media_round_trip(docs(spark, [*ODD, "b" * 64, "RIFF BM %PDF-1.4 GIF89a"])).collect()}
    for i, t in enumerate([*ODD, "b" * 64, "RIFF BM %PDF-1.4 GIF89a"]):
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest())
        assert got[i]["tail_crc32"] == zlib.crc32(p[-64:]) and got[i]["media_sha256"] == hashlib.sha256(media.to_wav(p)).hexdigest()
        assert got[i]["feature"] == "type=audio/wav;corrected=1;body=44;embedded=0"
    items = media.sniff(media.to_wav(b"noise" + png + b"BMxx"))
    assert [x.kind for x in items] == ["audio/wav", "image/png"] and media.carve(media.to_wav(b"noise" + png + b"BMxx"), items)[1] == png
    assert media.sniff(media.to_wav(b"abc")[:-3]) == [] and media.sniff(png[:-1]) == []


# 7
@pytest.mark.parametrize(("k", "percent", "hot"), [(4, 85, 64), (5, 80, 64), (4, 85, 3)])
def test_components_equal_brute_force(spark, monkeypatch, k, percent, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    r = random.Random(k * percent + hot)
    base, passage = words(r, 150), words(r, 60)
    texts = [*ODD, "Straße 😀  NAÏVE", "a b", "A  b", "a b c d", "A b\tc d"]
    texts += [edited(r, base, n % 9) for n in range(120)] + [words(r, 20) + " " + passage for _ in range(60)] + [passage + " " + words(r, 8) for _ in range(40)]
    for _ in range(15):
        t = words(r, r.randint(5, 200))
        texts += [t, t.upper(), edited(r, t, 1), edited(r, t, 3), " ".join(t.split()[:-1])]
    r.shuffle(texts)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.link_components(docs(spark, texts), k, percent).collect()}
    assert got == components_of(list(enumerate(texts)), k, percent)


def test_components_of_drifting_copies_equal_brute_force(spark):
    # chains of edits whose leaders have leaders of their own, so that groups of one hold another document than their leader
    r = random.Random(208)
    base = words(r, r.choice((60, 80, 120)))
    texts = [base]
    for _ in range(r.choice((8, 14, 20))):
        texts.append(edited(r, r.choice(texts[-3:]), 1 + r.randrange(2)))
    r.shuffle(texts)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.link_components(docs(spark, texts), 4, 85).collect()}
    assert got == components_of(list(enumerate(texts)), 4, 85)


def test_components_of_null_ids_and_nothing(spark):
    t = words(random.Random(9), 30)
    got = jaccard.link_components(docs(spark, [t, t, t, "lone words of five here", None], [None, 7, 7, None, None])).collect()
    assert sorted((x["component_id"] or -1) for x in got) == [-1, -1, 7, 7, 7]
    assert jaccard.link_components(docs(spark, [])).collect() == []
    kept = jaccard.keep_one(docs(spark, [t, t + " x", None, ""], [4, 2, 3, 1]))
    assert sorted(x["doc_id"] for x in kept.collect()) == [1, 2, 3] and kept.columns == docs(spark, []).columns


def test_connected_components(spark):
    r = random.Random(10)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 50)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    got = {x["node"]: x["root"] for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


# 8
def naive_spans(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: re.sub(r"\D", "", s)
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    r = random.Random(11)
    for _ in range(20000):
        t = "".join(r.choice("ab1 2.5+@-()09..@x\n4111") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(t) == naive_spans(t)


def test_tagger_on_held_out_texts():
    import numpy as np

    r, model = random.Random(12), trained()
    test = [labelled_text(r) for _ in range(300)]
    hit = wrong = missed = 0
    for (_, y), d in zip(test, model.viterbi(model.emissions(np.stack([symbols(t) for t, _ in test])))):
        a, b = set(tag_spans(np.array(y))), set(tag_spans(d))
        hit, wrong, missed = hit + len(a & b), wrong + len(b - a), missed + len(a - b)
    assert hit / (hit + wrong) > 0.9 and hit / (hit + missed) > 0.9


def test_pii_query_and_redaction(spark):
    text = "mail é ab.12@mail.example.com or +1 (826) 555-4081 190.137.223.204, card 4845168114407329 not 9807915762804490"
    d = docs(spark, [text, *ODD])
    got = {x["doc_id"]: x for x in pii.private_spans(d).collect()}
    base = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for k, a, b in naive_spans(text))
    assert got[0]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and set(base.split(",")) <= set(got[0]["spans"].split(","))
    assert (got[0]["n_email"], got[0]["n_ip"], got[0]["n_card"]) == (1, 1, 1)
    assert all(got[i]["spans"] == "" for i in range(1, len(ODD) + 1))
    new = {x["doc_id"]: x["text"] for x in pii.redacted(d).collect()}
    assert "<email>" in new[0] and "4845168114407329" not in new[0] and "9807915762804490" in new[0] and new[1] is None and new[6] == ODD[5]
    assert pii.redacted(d).schema.names == d.schema.names and pii.private_spans(docs(spark, [])).collect() == []


# 9
def test_archives_round_trip(spark):
    r = random.Random(13)
    big = words(r, 400)
    rows = [(i, f"http://h/{i} x\n", (big if i % 3 == 0 else words(r, 300)), None, None) for i in range(60)] + [(100, None, None, None, None), (101, "", "", None, None), (102, "u", "short", None, None), (103, "u", "short", None, None)]
    rows += [(57, "again", big, None, None), (None, "none", big, None, None)]
    got = collections.Counter(tuple(x) for x in warc.warc_round_trip(pages(spark, rows)).collect())
    want = collections.Counter()
    for i, _, h, _, _ in rows:
        raw = (h or "").encode()
        top = max(j for j, _, x, _, _ in rows if x == h and j is not None) if len(raw) >= 1000 else i
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if i == top else "revisit", None if i == top else top] += 1
    assert got == want
    assert warc.warc_round_trip(pages(spark, [])).collect() == []


def test_broken_archives_are_refused():
    records = [warc.record(i, "http://h/", b"payload %d " % i * 50, None) for i in range(40)]
    (archive,) = warc.archives(iter(records))
    assert list(warc.read_archive(archive)) == records
    for broken in (archive[:-1], b"", b"\x00" * 20, archive + b"\x00", archive[:-20] + b"\x00\x00\x00\x00" + archive[-16:]):
        with pytest.raises(warc.ArchiveError):
            [warc.parse_record(x) for x in warc.read_archive(broken)]
    for broken in (records[0].replace(b"payload", b"pay1oad"), records[0][:-2], records[0].replace(b"WARC-Type", b"WARC-Tipe"), records[0].replace(b"WARC/1.1", b"WARC/9")):
        with pytest.raises(warc.ArchiveError):
            warc.parse_record(broken)


# 10
def test_decontamination_equals_comparison_of_all_diagonals(spark):
    r = random.Random(14)
    items = [words(r, n) for n in (3, 8, 9, 13, 20, 45, 45)] + [None, "", "..."]
    texts = [*ODD, *(words(r, 60) for _ in range(20))]
    for t in items[:7]:
        texts += [words(r, 30) + " " + t + " " + words(r, 10), t.upper().replace(" ", ", "), edited(r, t, max(1, len(t.split()) // 8)) + " tail", " ".join(t.split()[: len(t.split()) // 2])]
    bench = spark.createDataFrame([(i, t, "s") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    got = {(x["doc_id"], x["item_id"]) for x in decontamination.contaminated(docs(spark, texts), bench).collect()}
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    sure, likely = set(), set()
    for i, t in enumerate(texts):
        w = split(t)
        for j, b in enumerate(map(split, items)):
            size = min(len(b), decontamination.WINDOW)
            for d in range(-len(b), len(w)) if b else ():
                same = [0 <= d + x < len(w) and w[d + x] == y for x, y in enumerate(b)]
                if max(sum(same[s : s + size]) for s in range(len(b) - size + 1)) >= 0.8 * size:
                    likely.add((i, j))
                    run = "".join("x" if s else "." for s in same)
                    if "x" * min(len(b), decontamination.SPAN) in run:
                        sure.add((i, j))
    assert sure <= got <= likely and len(sure) > 15
    assert decontamination.contaminated(docs(spark, []), bench).collect() == []
    assert decontamination.contaminated(docs(spark, texts), bench.limit(0)).collect() == []
    kept = decontamination.without_contaminated(docs(spark, texts), bench)
    assert {x["doc_id"] for x in kept.collect()} == set(range(len(texts))) - {i for i, _ in got}


def test_short_items_equal_comparison_of_all_diagonals(spark):
    r = random.Random(15)
    items = [words(r, n).split() for n in range(1, 13)]
    texts = []
    for t in items:
        allowed = len(t) - -(-4 * len(t) // 5)
        for gone in (c for k in range(allowed + 2) for c in itertools.combinations(range(len(t)), k)):
            texts.append([f"x{i}" if i in gone else w for i, w in enumerate(t)])  # the item alone, with one word too many at last
        texts += [[*words(r, 6).split(), *t[: len(t) - x]] for x in range(3)] + [[*t[x:], *words(r, 6).split()] for x in range(3)]  # past an end
    bench = spark.createDataFrame([(i, " ".join(t), "s") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    got = {(x["doc_id"], x["item_id"]): (x["matched"], x["similarity"]) for x in decontamination.contaminated(docs(spark, [" ".join(t) for t in texts]), bench).collect()}
    want = {}
    for i, w in enumerate(texts):
        for j, b in enumerate(items):
            best = max(sum(0 <= d + x < len(w) and w[d + x] == y for x, y in enumerate(b)) for d in range(-len(b), len(w) + 1))
            if 10 * best >= 8 * len(b):
                want[i, j] = (best, best / len(b))
    assert got == want
