import random
import re

import pyarrow as pa

from quarry.llm import substring_dedup as sd

SCHEMA = "doc_id bigint, text string, digest int, spans string, keeper int"
WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0, "", 0) for i, t in rows], SCHEMA)


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklé") for _ in range(rng.randrange(2, 9))) for _ in range(n)]


def planted(seed=1):
    """Passages of 60 to 120 words in the middle of lines of other documents."""
    rng = random.Random(seed)
    passages = [words(rng, rng.randrange(60, 121)) for _ in range(12)]
    rows, places = [], {}
    for d in range(150):
        w = words(rng, rng.randrange(30, 300))
        if d % 3 == 0:
            p = rng.randrange(12)
            at = rng.randrange(len(w))
            body = " ".join(passages[p])
            before = " ".join(w[:at]) + (" " if at else "")
            places[d] = (p, len(before), len(before) + len(body))
            rows.append((d, before + body + " " + " ".join(w[at:])))
        else:
            rows.append((d, "\n".join(" ".join(w[i:i + 40]) for i in range(0, len(w), 40))))
    return rows, places


def test_planted_passages_and_clean_documents(spark):
    rows, places = planted()
    extra = [(900, None), (901, ""), (902, " ,. \n"), (903, "short"), (904, "long " * 60_000)]
    got = {r.doc_id: r for r in sd.span_report(docs(spark, rows + extra)).collect()}
    assert len(got) == len(rows) + 5
    first, texts = {}, dict(rows)
    for d in sorted(places):
        first.setdefault(places[d][0], d)
    for d, t in rows:
        spans = [tuple(map(int, s.split(":"))) for s in got[d].spans.split(",") if s]
        if d not in places or first[places[d][0]] == d:
            assert spans == [], d                                   # clean documents and first places stay
            continue
        _, a, b = places[d]
        assert spans == [(a, b)]
        assert got[d].removed_chars == spans[0][1] - spans[0][0] and got[d].removed_words >= 60
    assert all(got[d].n_spans == 0 for d in (900, 901, 902, 903))


def test_removal_keeps_the_rest_and_all_columns(spark):
    rows, places = planted(4)
    out = sd.remove_repeats(docs(spark, rows))
    assert out.columns == ["doc_id", "text", "digest", "spans", "keeper"]
    spans = {r.doc_id: r.spans for r in sd.span_report(docs(spark, rows)).collect()}
    for r in out.collect():
        t, at, want = dict(rows)[r.doc_id], 0, ""
        for s in filter(None, spans[r.doc_id].split(",")):
            a, b = map(int, s.split(":"))
            want, at = want + t[at:a], b
        assert r.text == want + t[at:]


def test_whole_copies_and_case(spark):
    rng = random.Random(7)
    base = " ".join(words(rng, 200))
    got = {r.doc_id: r for r in sd.span_report(docs(spark, [(5, base), (3, base.upper()), (4, base.replace(" ", ",\n")), (4, base)])).collect()}
    assert got[3].n_spans == 0 and got[5].removed_words == 200 and got[4].removed_words == 200


def test_repeat_inside_a_document_and_empty_table(spark):
    rng = random.Random(8)
    p, q = " ".join(words(rng, 80)), " ".join(words(rng, 50))
    [r] = sd.span_report(docs(spark, [(1, f"{p} {q} {p}")])).collect()
    a, b = map(int, r.spans.split(":"))
    assert (a, b) == (len(p) + len(q) + 2, len(p) * 2 + len(q) + 2)
    assert sd.span_report(docs(spark, [])).count() == 0


def normal(text):
    return tuple(m.group().translate(LOW) for m in WORD.finditer(text or ""))


LOW = str.maketrans({chr(i): chr(i + 32) for i in [*range(65, 91), *(c for c in range(0xC0, 0xDF) if c != 0xD7)]})


def places(text):
    return [(m.start(), m.end()) for m in WORD.finditer(text or "")]


def stretches(marks, at, least):
    """Marked words as (start, end) code points of stretches of at least ``least`` words."""
    out, i = [], 0
    while i < len(marks):
        j = i
        while j < len(marks) and marks[j]:
            j += 1
        if j - i >= least:
            out.append((at[i][0], at[j - 1][1]))
        i = max(j, i + 1)
    return out


def brute_lines(rows, least):
    """Words of lines and paragraphs that occurred earlier, by sorting rows and reading on."""
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda r: r[0]):
        marks, lines, word = [], [], 0
        for line in (text or "").split("\n"):
            n = len(WORD.findall(line))
            lines.append((word, word + n))
            word += n
        marks = [False] * word
        units, run = set(lines), []
        for a, b in [*lines, (0, 0)]:
            if a == b:
                if run:
                    units.add((run[0][0], run[-1][1]))
                run = []
            else:
                run.append((a, b))
        w = normal(text)
        for a, b in sorted(units):
            if b - a < least:
                continue
            if w[a:b] in seen:
                marks[a:b] = [True] * (b - a)
            seen.add(w[a:b])
        out[d] = stretches(marks, places(text), least)
    return out


def brute_windows(rows, least):
    """Words of windows of ``least`` words that occurred earlier."""
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda r: r[0]):
        w = normal(text)
        marks = [False] * len(w)
        for i in range(len(w) - least + 1):
            if w[i:i + least] in seen:
                marks[i:i + least] = [True] * least
            seen.add(w[i:i + least])
        out[d] = stretches(marks, places(text), least)
    return out


def spans_of(df):
    return {r.doc_id: [tuple(map(int, s.split(":"))) for s in r.spans.split(",") if s] for r in df.collect()}


def test_lines_and_paragraphs_equal_brute_force(spark):
    rng = random.Random(21)
    lines = [" ".join(words(rng, rng.randrange(1, 9))) for _ in range(60)] + ["", "--", ""]
    rows = [(d, "\n".join(rng.choice((str, str.upper))(rng.choice(lines)) for _ in range(rng.randrange(0, 25)))) for d in range(120)]
    rows += [(500, None), (501, "")]
    for least in (1, 4, 9):
        assert spans_of(sd.span_report(docs(spark, rows), least, windows=False)) == brute_lines(rows, least), least


def test_passages_of_51_words_are_all_found_and_clean_documents_are_not_marked(spark):
    """In running text, on lines of their own, and broken into other lines; next to nothing else that repeats."""
    rng = random.Random(22)
    rows, want = [], {}
    for n in range(200):
        p = words(rng, 51)
        for copy in range(2):
            d = 1000 * copy + n
            before, after = words(rng, rng.randrange(0, 60)), words(rng, rng.randrange(0, 60))
            style = (n + copy) % 3
            gap = " " if style == 0 else "\n"
            body = " ".join(p) if style < 2 else "\n".join(" ".join(p[i:i + 7]) for i in range(0, 51, 7))
            head = " ".join(before) + gap if before else ""
            rows.append((d, head + body + (gap + " ".join(after) if after else "")))
            want[d] = [(len(head), len(head) + len(body))] if copy else []
    clean = [(5000 + i, "\n".join(" ".join(words(rng, 30)) for _ in range(9))) for i in range(100)]
    got = spans_of(sd.span_report(docs(spark, rows + clean)))
    assert got == want | {d: [] for d, _ in clean}


def test_equals_windows_that_occurred_earlier(spark):
    """Overlapping and partial passages: nothing is marked but windows of 10 words (the size hashed for 12)
    that occurred before, and windows of 12 that did are covered, but for words beside an earlier smaller part."""
    rng = random.Random(23)
    source = words(rng, 3000)
    rows = []
    for d in range(150):
        text = []
        for _ in range(rng.randrange(1, 4)):
            a = rng.randrange(2900)
            text += source[a:a + rng.randrange(5, 60)] + words(rng, rng.randrange(1, 20))
        rows.append((d, rng.choice((" ", "\n", ", ")).join(text)))
    want, got = brute_windows(rows, 12), spans_of(sd.span_report(docs(spark, rows), 12))
    size, _ = sd.window_sizes(12)
    may = brute_windows(rows, size)
    missed = total = 0
    for d, text in rows:
        held = [any(a <= x and y <= b for a, b in got[d]) for x, y in places(text)]
        must = [any(a <= x and y <= b for a, b in want[d]) for x, y in places(text)]
        missed, total = missed + sum(m and not h for m, h in zip(must, held)), total + sum(must)
        assert all(any(a <= x and y <= b for a, b in may[d]) for x, y in got[d]), d
        assert all(len(WORD.findall(text[a:b])) >= 12 for a, b in got[d]), d
    assert total > 3000 and missed <= 0.01 * total


def test_rows_of_one_id_with_other_texts_keep_their_own_offsets(spark):
    rng = random.Random(24)
    p, q = " ".join(words(rng, 70)), " ".join(words(rng, 20))
    rows = [(1, p), (2, f"{q} {p}"), (2, f"{p} {q}"), (None, p)]
    got = {(r.doc_id, r.spans) for r in sd.span_report(docs(spark, rows)).collect()}
    assert got == {(1, ""), (2, f"{len(q) + 1}:{len(p) + len(q) + 1}"), (2, f"0:{len(p)}"), (None, "")}
    assert sorted(r.text.strip() for r in sd.remove_repeats(docs(spark, rows)).collect()) == sorted([p, q, q, p])


def test_units_hold_every_line_and_a_window_of_every_span():
    rng = random.Random(2)
    text = " ".join(words(rng, 500))
    raw, offsets = sd.text_buffers(pa.array([text, "x " * 37 + text, "\n".join([text, text]), ""]))
    u = sd.Units(raw, offsets)
    size, span = sd.window_sizes(sd.MIN_WORDS)
    assert size + span - 1 == sd.MIN_WORDS
    lines = [(d, a, b) for d, a, b, w in zip(u.doc, u.first, u.last, u.window) if not w]
    assert lines == [(0, 0, 500), (1, 500, 1037), (2, 1037, 1537), (2, 1037, 2037), (2, 1537, 2037)]
    for d, n in enumerate((500, 537, 1000)):
        at = u.first[(u.doc == d) & u.window] - u.words.first[d]
        assert all(((at >= s) & (at < s + span)).any() for s in range(n - sd.MIN_WORDS + 1))
    assert set(u.digest[(u.doc == 0) & u.window]) <= set(u.digest[u.doc == 1])
