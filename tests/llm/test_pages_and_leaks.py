"""WARC round trips, main text, and benchmark leaks against brute force."""

import hashlib
import random
import re
import time
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
import zstandard

from vitaeflow.llm import decontamination, html_text, warc

PAGES = "page_id long, url string, html string, gone string, digest string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)


SAME = "<p>" + "the same long payload " * 10 + "</p>"
ROWS = [(5, "http://a.example/x", SAME), (2, "http://a.example/y\r\nX: 1", SAME), (9, None, SAME), (2, "http://a.example/y", SAME), (3, "http://b.example/", "short"), (4, "http://b.example/", "short"), (6, "u", None), (7, "u", ""), (None, "n", SAME), (8, "http://c.example/ü", "é" * 20000)]


@pytest.fixture(scope="module")
def archived(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('warc')}"
    frame = pages_of(spark, ROWS + [(100 + i, f"http://d.example/{i}", f"<html><body>page number {i} of many</body></html>" * 3) for i in range(60)])
    made = warc.write_archives(frame, folder).collect()
    return folder, made, warc.read_archives(spark.createDataFrame(made), folder).collect()


def test_round_trip(archived):
    _, made, back = archived
    assert len(back) == len(ROWS) + 60 == sum(r["records"] for r in made)
    html = {i: h or "" for i, _, h in ROWS if i is not None}
    for r in back:
        if r["page_id"] in html:
            raw = html[r["page_id"]].encode()
            assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
            assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == raw
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in back if r["payload_digest"] == hashlib.sha256(SAME.encode()).hexdigest())
    assert kinds == [(0, "response", None), (2, "response", None), (2, "response", None), (5, "revisit", 2), (9, "revisit", 2)]
    assert {r["record_type"] for r in back if r["page_id"] in (3, 4, 6, 7)} == {"response"}


def test_archives_are_frames_of_their_own(archived):
    folder, made, _ = archived
    for r in made:
        raw = open(r["archive"], "rb").read()
        view, at, frames = memoryview(raw), 0, []
        while size := warc.frame_length(view, at):
            frames.append(raw[at : at + size])
            at += size
        assert at == len(raw) == r["bytes"] and int.from_bytes(frames[0][:4], "little") == warc.DICTIONARY_MAGIC and len(frames) == r["records"] + 1
        own = zstandard.ZstdCompressionDict(frames[0][8:])
        assert zstandard.ZstdDecompressor(dict_data=own).decompress(frames[-1]).startswith(b"WARC/1.1\r\n")
        assert b"\r\nX: 1\r\n" not in zstandard.ZstdDecompressor(dict_data=own).decompress(frames[-1])


def test_damage_is_noticed(archived, tmp_path):
    folder, made, _ = archived
    raw = open(made[0]["archive"], "rb").read()
    (tmp_path / "cut").write_bytes(raw[:-5])
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records(f"file://{tmp_path}", str(tmp_path / "cut")))


def test_warc_of_an_empty_table(spark, tmp_path):
    made = warc.write_archives(pages_of(spark, ROWS).limit(0), f"file://{tmp_path}")
    assert made.count() == 0 and warc.read_archives(made, f"file://{tmp_path}").count() == 0


def texts(page):
    return [x.text for x in html_text.lines(page) if not x.away]


def test_lines():
    page = "<html><title>t</title><nav><a href='/x'>X</a></nav><article><h1>A &amp; B</h1><p>one <b>two</b>\n three<p>four<br>five</article><div class='ad'>buy</div><script>var t='</p>'</script><!-- no --><footer>f</footer>"
    assert texts(page) == ["A & B", "one two three", "four", "five"] and all(x.main for x in html_text.lines(page) if not x.away)
    assert texts("") == [] and texts("<script>never closed") == [] and texts("a < b & c") == ["a < b & c"]
    assert texts("one <a title=it's>link</a> two") == ["one link two"] and texts("x <b and <i y") == ["x"]
    assert texts("<DIV>x</DIV\n>y<img alt='>'>z<![CDATA[q]]><?x?>") == ["x", "yz"]
    assert texts("<p>long enough a text</p><span class=ad><span>buy</span> now</span> at once") == ["long enough a text", "at once"]


def test_wrappers_are_no_furniture():
    whole = "<p>The text of the page.</p>"
    for around in ("<div class='layout no-sidebar'>{}</div>", "<form id=aspnetForm>{}</form>", "<article class='post related-topic-share'>{}</article>", "<div class=menu-open><h1>T</h1>{}</div>"):
        assert "The text of the page." in texts("<nav>" + "menu " * 50 + "</nav>" + around.format(whole))
    page = f"<div>{whole * 20}</div><article>A teaser</article>"
    assert html_text.chosen(html_text.lines(page), set()).startswith("The text of the page.")
    assert html_text.chosen(html_text.lines(f"<div>notice</div><article>{whole}</article>"), set()) == "The text of the page."


@pytest.mark.parametrize("piece, end", [("<a b='", ""), ("<a b='x' ", ""), ('<a b="', "'"), ("<div>", "</q>" * 8000), ("<div class=menu>", "x"), ("<", ""), ("<!--", ""), ("</p", ""), ("<script", ""), ("<p x=", "")])
def test_hostile_pages_take_linear_time(piece, end):
    start = time.process_time()
    html_text.lines(piece * 8000 + end)
    assert time.process_time() - start < 0.5


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("cells", [4_000_000, 4])
def test_alignment_is_longest(monkeypatch, cells):
    monkeypatch.setattr(html_text, "ALIGN_CELLS", cells)
    rng = np.random.default_rng(1)
    for _ in range(150):
        a, b = (rng.integers(0, 6, rng.integers(0, 14)) for _ in range(2))
        got = html_text.common(a, b)
        assert len(got) == lcs(a.tolist(), b.tolist()) and all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def site(k, body):
    return f"<div>Site menu line</div><div>{body}</div><div>More of page {k}</div><div>Site bottom line</div>"


def test_differencing_deletes_what_neighbours_share(spark):
    rows = [(k, f"http://h.example/p/{k:02d}", site(k, f"Own text of page {k}, which is long enough to count for more than the frame")) for k in range(20)]
    rows += [(50, "http://lone.example/", site(50, "Alone")), (51, None, None), (52, "http://c.example/1", "<article>copy text</article>"), (53, "http://c.example/2", "<article>copy text</article>"), (3, *rows[3][1:])]
    got = {r["page_id"]: r for r in html_text.extract(pages_of(spark, rows)).collect()}
    assert html_text.extract(pages_of(spark, rows)).count() == len(rows)
    for k in range(20):
        assert got[k]["text"] == f"Own text of page {k}, which is long enough to count for more than the frame More of page {k}" and got[k]["n_chars"] == len(got[k]["text"])
    assert got[50]["text"].startswith("Site menu line Alone") and got[51]["text"] == "" and got[52]["text"] == got[53]["text"] == "copy text"
    assert html_text.extract(pages_of(spark, rows).limit(0)).count() == 0


class Blocks(HTMLParser):
    """The lines of a well-formed page: text, main, heading, place, place around, furniture."""

    def __init__(self, page):
        super().__init__()
        self.stack, self.held, self.out = [], [], []
        self.feed(page)
        self.settle()

    def settle(self):
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            place = tuple((t, re.sub(r"[0-9]", "", c)) for t, c in self.stack)
            names = [t for t, _ in self.stack]
            away = any(t in ("nav", "footer", "aside") or c in ("ad", "comments", "menu", "sidebar") for t, c in self.stack)
            self.out.append((text, "article" in names, any(t[0] == "h" and t[1:].isdigit() for t in names), place, place[:-1], away))

    def handle_starttag(self, tag, attrs):
        self.settle()
        self.stack.append((tag, dict(attrs).get("class", "")))

    def handle_endtag(self, tag):
        self.settle()
        self.stack.pop()

    def handle_data(self, data):
        self.held.append(data)


def brute_texts(rows):
    """Main texts by pairs, places and lines counted one by one; pages are read by another parser."""
    parsed = [(*html_text.place_of(u or ""), i, Blocks(h or "").out) for i, u, h in rows]
    order = sorted(range(len(rows)), key=lambda k: (*parsed[k][:3], k))

    def shared(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                table[i][j] = table[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(table[i + 1][j], table[i][j + 1])
        i = j = 0
        while i < len(a) and j < len(b):
            if a[i][0] == b[j][0]:
                yield i
                i, j = i + 1, j + 1
            elif table[i + 1][j] >= table[i][j + 1]:
                i += 1
            else:
                j += 1

    told, near = defaultdict(set), defaultdict(list)
    for k in order:
        host, own = parsed[k][0], parsed[k][3]
        if not own or any([x[0] for x in own] == [x[0] for x in parsed[j][3]] for j in near[host]):
            continue
        for j in near[host]:
            for x, y in ((k, j), (j, k)):
                same = list(shared(parsed[x][3], parsed[y][3]))
                if sum(len(parsed[x][3][i][0]) for i in same) <= 0.5 * sum(len(z[0]) for z in parsed[x][3]):
                    told[x] |= set(same)
        near[host] = [*near[host], k][-32:]
    n, times, size, inside = (defaultdict(lambda: defaultdict(int)) for _ in range(4))
    for k, same in told.items():
        for i, (text, main, heading, place, _, _) in enumerate(parsed[k][3]):
            host = parsed[k][0]
            n[host][place] += 1
            times[host][place] += i in same
            size[host][place] += len(text)
            inside[host][place] |= main or heading
    frame = set()
    for host, own in n.items():
        body = max(size[host], key=size[host].get)
        for place, count in own.items():
            least = 0.5 if inside[host][place] or place[:-1] == body[:-1] else max(0.05, 1.5 * times[host][body] / own[body])
            if place != body and times[host][place] >= 3 and times[host][place] / count >= least:
                frame.add((host, place))
    out = []
    for k, (host, _, _, own) in enumerate(parsed):
        left = [x for i, x in enumerate(own) if (host, x[3]) not in frame and not (i in told.get(k, ()) and not x[1]) and not x[5]]
        inner, outer = (sum(len(x[0]) for x in left if x[1] == m) for m in (True, False))
        alone = any(x[1] for x in left) and not (outer >= 200 and outer > 4 * inner)
        out.append(" ".join(x[0] for x in left if x[1] or not alone))
    return out


def marked_site(rng, k, quote=None):
    """An article with a notice, which the site repeats with changing words, and sometimes a quotation."""
    body = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(8, 30))) for _ in range(rng.randint(2, 6))]
    if quote:
        body.insert(rng.randrange(len(body)), quote)
    paragraphs = "".join(f"<p>{x}</p>" for x in body)
    return "<nav>menu</nav><article><h1>Title {}</h1>{}<div class=box{}>Read more of our news</div></article>".format(k, paragraphs, k), " ".join([f"Title {k}", *body])


def test_differencing_acts_inside_articles_and_keeps_quotations(spark):
    rng = random.Random(12)
    quote = " ".join(f"q{k}" for k in range(20))
    made = [marked_site(rng, k, quote if k % 2 else None) for k in range(30)]
    rows = [(k, f"http://news.example/{k:03d}", html) for k, (html, _) in enumerate(made)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages_of(spark, rows)).collect()}
    assert [got[k] for k in range(30)] == [text for _, text in made] == brute_texts(rows)
    assert all("Read more" in html_text.chosen(html_text.lines(html), set()) for _, _, html in rows)  # differencing took it away


def test_furniture_goes_at_any_length():
    prose = "<p>The text of the page, in a few more words.</p>"
    long = "".join(f"<p>Somebody says something of their own about it, number {k}</p>" for k in range(60))
    menu = "".join(f"<p>Entry {k}</p>" for k in range(60))
    want = ["The text of the page, in a few more words."]
    for page in (
        f"<article>{prose}<div class=comments>{long}</div></article>", f"<div>{prose}</div><div id='comments'>{long}</div>", f"<div class=menu>{menu}</div>{prose}", f"<div class='left sidebar'><h1>More</h1>{long}</div>{prose}",
        f"<article>{prose}<div class=alert>Please note that we use your data</div></article>", f"<div hidden>{long}</div>{prose}", f"<form>{long}</form><article>{prose}</article>", f"<div class=menu>{menu}</div><div class='content share'>{prose}</div>",
        f"<div class='page-with-sidebar sidebar'><div class=sidebar>{menu}</div><main>{prose}</main></div>", f"<p data-x='hidden'></p>{prose}<div class=x hidden=until-found>{long}</div>",
    ):
        assert texts(page) == want, page
    assert texts(f"<div class=menu>{menu}</div>") == []


def random_site(rng, pages):
    """Pages with menus, adverts and footers of a host's own words, in no marked elements; texts are their own."""
    words, ads = [f"m{k}" for k in range(12)], [f"Buy some {k} now" for k in range(5)]
    out = []
    for k in range(pages):
        body = [" ".join(f"u{rng.randrange(5000)}" for _ in range(rng.randint(6, 25))) for _ in range(rng.randint(2, 5))]
        menu = "".join(f"<li>{w}</li>" for w in rng.sample(words, 4))
        page = f"<div class=top><ul>{menu}</ul></div><div class=promo{k}x><b>{rng.choice(ads)}</b></div><div class=text><h2>Title {k % 9} of it</h2>{''.join(f'<p>{x}</p>' for x in body)}</div><div class=end>{rng.choice(ads)} and so on</div>"
        out.append((page, " ".join([f"Title {k % 9} of it", *body])))
    return out


def test_frames_of_changing_lines_are_told_by_places(spark, monkeypatch):
    rng = random.Random(3)
    made = random_site(rng, 60)
    rows = [(k, f"http://s.example/{rng.randrange(10**6):06d}", html) for k, (html, _) in enumerate(made)]
    for changed in ({}, {"RUN": 40, "WIDTH": 12}):
        for name, value in changed.items():
            monkeypatch.setattr(html_text, name, value)
        got = {r["page_id"]: r["text"] for r in html_text.extract(pages_of(spark, rows)).collect()}
        assert all(text.endswith(got[k]) and len(got[k]) >= len(text) - 15 for k, (_, text) in enumerate(made))  # a title that others have may go


def test_extraction_is_that_of_brute_force(spark, monkeypatch):
    rng = random.Random(13)
    rows = []
    for k in range(160):
        host = f"h{rng.randrange(4)}.example"
        page = marked_site(rng, k)[0] if k % 3 else site(rng.randrange(3), " ".join(f"u{rng.randrange(4000)}" for _ in range(rng.randint(1, 60))))
        rows.append((k, f"https://{host}/a/{rng.randrange(300)}", rows[-1][2] if k % 17 == 5 else page))
    rows += [(300, None, None), (301, "no url", "<p>x"), (302, "http://[", "y"), (303, "http://h1.example/a/7", "word " * 50_000)]
    want = dict(zip((r[0] for r in rows), brute_texts(rows), strict=True))
    for limit in (html_text.BROADCAST_BYTES, 0):
        monkeypatch.setattr(html_text, "BROADCAST_BYTES", limit)
        assert {r["page_id"]: r["text"] for r in html_text.extract(pages_of(spark, rows)).collect()} == want


def test_leaks_are_those_of_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ta", "ro", "mi", "ke", "su"]) for _ in range(rng.randint(1, 3)))
    items = [(i, " ".join(word() for _ in range(rng.choice([6, 20, 58, 150])))) for i in range(40)] + [(90, None), (91, ""), (92, "single"), (0, None)]
    docs, planted = [], set()
    for d in range(120):
        words = [word() for _ in range(rng.choice([0, 30, 200, 900]))]
        if d % 3 == 0:
            i, text = rng.choice(items[:40])
            at = rng.randrange(len(words) + 1)
            words[at:at] = text.upper().split()
            planted.add((d, i))
        docs.append((d, " \n".join(words), "clash"))
    docs += [(500, None, ""), (None, items[1][1], ""), (501, "single", ""), (502, "single more", "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_leaks(frame, bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    brute = set()
    for d, text, _ in docs:
        own = decontamination.words_of((text or "").encode())
        for i, t in items:
            want = decontamination.words_of((t or "").encode())
            if len(want) > 1 and any(own[k : k + len(want)] == want for k in range(len(own))) or len(want) == 1 and own == want:
                brute.add((d, i))
    assert planted <= brute and got == brute and len(found) == len(got)
    clean = decontamination.without_leaks(frame, bench)
    assert clean.columns == frame.columns and {r["doc_id"] for r in clean.collect()} == {d for d, *_ in docs} - {d for d, _ in brute}
    assert decontamination.find_leaks(frame.limit(0), bench).count() == 0 and decontamination.find_leaks(frame, bench.limit(0)).count() == 0


def test_index_parts_leave_nothing_out(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "MAX_INDEX_WORDS", 5)
    bench = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i} delta{i}") for i in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x alpha{i} beta{i} gamma{i} delta{i} y") for i in range(5)], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs, bench).collect()} == {(i, i) for i in range(5)}


def brute_overlaps(words, item):
    """Question and answer overlap of an item of one segment with the passages that score enough."""
    cut = len(item) - max(1, len(item) // 4)
    out = []
    for start in range(0, max(1, len(words) - 64), 64):
        own = words[start : start + 128]
        pairs = {(i, own[k], own[k + i]) for i in (1, 2) for k in range(len(own) - i)}
        held = [any((i, item[k], item[k + i]) in pairs for i in (1, 2) if k + i < len(item)) or any((i, item[k - i], item[k]) in pairs for i in (1, 2) if k >= i) for k in range(len(item))]
        share = sum((1, item[k], item[k + 1]) in pairs for k in range(len(item) - 1)) / (len(item) - 1)
        out.append((share, held))
    met = [h for s, h in out if s >= 0.6]
    if not met:
        return 0.0, 0.0
    held = [any(h[k] for h in met) for k in range(len(item))]
    return sum(held[:cut]) / cut, sum(held[cut:]) / (len(item) - cut)


def test_partial_overlaps_are_judged_as_by_brute_force(spark):
    rng = random.Random(14)
    items = [(i, [f"i{i}w{k}" for k in range(rng.choice([12, 20, 33, 60]))]) for i in range(30)]  # pairs of equal weight
    docs = []
    for d in range(400):
        words = [f"o{rng.randrange(900)}" for _ in range(rng.choice([20, 150, 400]))]
        own = list(items[d % 30][1])
        for _ in range(rng.randint(0, len(own) // 2)):
            k = rng.randrange(len(own))
            own[k : k + 1] = rng.choice([[], ["changed"], [own[k], "more"]])
        at = rng.randrange(len(words))
        words[at:at] = own
        docs.append((d, " ".join(words)))
    found = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): (r["question_overlap"], r["answer_overlap"]) for r in found.collect()}
    want = {(d, d % 30): brute_overlaps(t.split(), items[d % 30][1]) for d, t in docs}
    want = {k: v for k, v in want.items() if min(v) >= 0.8}
    assert 100 < len(want) < 390 and got == want


def test_a_large_item_table_is_indexed_in_parts_by_words(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "MAX_INDEX_WORDS", 1000)
    bench = spark.createDataFrame([(i, "\n".join(f"b{i}x{k}" for k in range(300))) for i in range(20)], "item_id long, text string")
    made = list(decontamination.indexes(bench))
    assert len(made) >= 6 and sum(len(x.items) for x in made) == 20 and max(len(x.words) for x in made) < 1700


def test_wand_retrieves_all_above_the_threshold(monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK", 2)
    rng = random.Random(4)
    items = [(i, b" ".join(rng.choice([b"a", b"b", b"c", b"d", b"e", b"f"]) for _ in range(rng.randint(2, 9)))) for i in range(60)]
    index = decontamination.Index(items)
    for _ in range(200):
        pairs = sorted(rng.sample(range(len(index.pairs)), rng.randint(1, 12)))
        scores = {}
        for p in pairs:
            for segment, w in zip(*index.postings(p), strict=True):
                scores[int(segment)] = scores.get(int(segment), 0) + w
        for threshold in (0.2, 0.5, 0.9):
            got = index.search(pairs, threshold)
            assert {s for s, _ in got} == {s for s, v in scores.items() if v >= threshold - 1e-9}
            assert all(v == pytest.approx(scores[s]) for s, v in got)
    assert index.look_up([[]]) == [[]]
