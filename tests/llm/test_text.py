"""PII, HTML and toxicity against fixed cases, brute force and held-out labels."""

import hashlib
import re
import time

from edges import SCHEMA, odd
from tracelore.llm import html_text, pii, toxicity

FOLDER = "/root/testdata/sf0.001"
PII = [
    "a.b%c@x-y.co.uk, x@y, @z.com a@b.co@c.de, .@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 1.2.3 12.34.56.78x 9999.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111",
    "+1 (988) 555-2485 +12 +1234567890123456 ++44 20 7946 0958.", "1" * 5000 + "." + "1" * 5000, "a" * 20000 + "@" + "b" * 2000 + ".c", "+" * 300 + "1" * 300, "", None, "٣٣٣٣٣٣٣٣٣٣٣٣٣ +٣٣٣٣٣٣٣٣٣٣٣",
    "0 0 0 0 0 0 0 0 0 0 0 0 0", "x@y.z" * 50, "1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6-7-8-9-0",
]


def brute_pii(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_pii_base(spark):
    short = [t for t in PII if t is None or len(t) < 11000]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").unionByName(odd(spark)).unionByName(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(short)], SCHEMA))
    got = sorted((str(r["doc_id"]), r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii.personal_report(docs).collect())
    want = []
    for r in docs.collect():
        found = brute_pii(r["text"] or "")
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in found)
        want.append((str(r["doc_id"]), hashlib.sha256(said.encode()).hexdigest(), *[sum(k == i for k, _, _ in found) for i in range(4)]))
    assert got == sorted(want)
    assert pii.base_spans(PII[5]) == [(0, 0, len(PII[5]))]
    assert pii.personal_report(docs.limit(0)).count() == 0


def test_patterns_discover(spark):
    seeds = [f"call me, phone: +1 212 555 {n:04d} today" for n in range(1000, 1008)]
    texts = [*seeds, "phone: 555-0199-77 is mine", "phone: 555-0188-66.", "token=abcd1234 here", "build: 20240101", "phone number is 5550123", "phone: nothing"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(8, texts[8], "en", "s", 0)], SCHEMA)
    rows = pii.personal_report(docs).collect()
    found = {r["doc_id"]: r["spans"] for r in rows}
    assert len(rows) == len(texts) + 1
    assert found[8] == "found:7:18" and found[9] == "found:7:18"
    assert all(found[i] == "" for i in (10, 11, 12, 13))
    assert all(found[i].startswith("phone:") and "found" not in found[i] for i in range(8))


def test_trust_settles(spark):
    """A label with fewer than 80% seeds is not personal, one with 80% is; a chain of patterns is followed to its end."""
    rows = [(f"mixed{share}", f"{share}v{i}", i < share) for share in (42, 79, 80) for i in range(100)]
    rows += [("hop0", f"s{i}", True) for i in range(16)] + [("hop0", f"v1.{i}", False) for i in range(4)]
    for hop in range(1, 8):
        rows += [(f"hop{hop}", f"v{hop}.{i}", False) for i in range(4)] + [(f"hop{hop}", f"v{hop + 1}.0", False)]
        rows += [(f"side{hop}", f"s{i}", True) for i in range(16)] + [(f"side{hop}", f"v{hop}.{i}", False) for i in range(1, 4)]
    found = spark.createDataFrame(rows, "pattern string, instance string, seed boolean")
    got = {(r["pattern"], r["instance"]) for r in pii.trusted_instances(found).collect()}
    assert not any(p in ("mixed42", "mixed79") for p, _ in got)
    assert {i for p, i in got if p == "mixed80"} == {f"80v{i}" for i in range(80, 100)}
    assert ("hop7", "v8.0") in got


def test_ties_in_any_case_and_space():
    """Found with and without a colon elsewhere in the text."""
    for said in ("Account Number 12345678", "account number\n12345678", "account\tnumber\t12345678", "account number (12345678"):
        at = said.index("1")
        assert pii.instances(said, []) == [("account number", "12345678", at, at + 8, False)] == pii.instances(said + " so: yes", [])


def test_long_tokens_are_whole():
    value = "9f" * 100
    assert pii.instances(f"key: {value} end", []) == [("key:", value, 5, 205, False)]
    url = "https://example.com/" + "a" * 41 + "?id=" + value
    assert [(label, a, b) for label, _, a, b, _ in pii.instances(f"see: {url}", [])] == [("https://example.com/" + "a" * 41 + "?id=", 70, 270)]


PAGES = [
    (None, ""), ("", ""), ("plain &lt;text&gt; only", ""), ("<article><p>A&amp;B  <b>bold</b>\n x<br>y<p>second &eacute;</article>", "A&B bold x y second é"),
    ("<html><head><title>T</title></head><body><header>Site</header><nav><a href=x>m</a></nav><article><header><h1>Title here</h1></header><p>Body of text.</p><div class='comments'><p>First!</p></div><form>q</form></article><aside>s</aside><footer>f</footer>", "Title here Body of text."),
    ("<article><p>one<script>var t='</p><p>no';</script> two</p><style>p{}</style><!-- <p>no</p> --><p>three", "one two three"), ("<article><p>cut &am", "cut &am"), ("<article><p>cut <a hre", "cut"),
    ("<article><p title='a>b'>x</p><p hidden>no</p><div id=\"cookie-banner\">no</div><p style='display:none'>no</p></article>", "x"),
    ("<body><div><a href=1>Home</a> <a href=2>About us and more of the things that we do</a></div><div>" + "The cat sat on the mat and it was happy with the sun in the garden. " * 4 + "</div><p>Short end.</p><div class=sidebar>" + "the of and " * 40 + "</div></body>",
     ("The cat sat on the mat and it was happy with the sun in the garden. " * 4).strip() + " Short end."),
    ("<body><div class='site-header'>S</div><div class='content with-sidebar'><article class='post has-comments'><div class='article-header'><h2>Head</h2></div><p>Text.</p><article class='comment'><p>Nice</p></article></article></div></body>", "Head Text."),
    ("<body><div class='overlay'><article><p>all of it</p></article></div></body>", "all of it"), ("<article><p>a<div class=adBanner>x</div><p>b<p class=additional>c</article>", "a b c"), ("<article><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></article>", "a b 1 2"), ("<main><p>in main</main><article><p>second root</article>", "in main second root"), ("<" * 50, ""), ("<article>a < b <3</article>", "a < b <3"),
]


def test_pages(spark):
    rows = [(i, f"u{i}", h) for i, (h, _) in enumerate(PAGES)] + [(None, None, "<article>x</article>"), (2**60 + 1, "u", "<article>" + "w " * 200000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = {r["page_id"]: r for r in html_text.extract_pages(df).collect()}
    for i, (h, want) in enumerate(PAGES):
        assert got[i]["text"] == want, (i, h)
        assert got[i]["n_chars"] == len(want)
    assert got[None]["text"] == "x" and got[2**60 + 1]["n_chars"] == 399999
    assert html_text.extract_pages(df.limit(0)).count() == 0


def test_articles_of_given_pages(spark):
    """The given pages mark their text by one article element: the plain text of that element is the answer."""
    import html as entities

    rows = html_text.extract_pages(spark.read.parquet(f"{FOLDER}/pages.parquet")).collect()
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    assert len(rows) == len(source)
    for r in rows:
        body = re.sub(r"<[^>]*$", "", re.search(r"<article>(.*?)(</article>|$)", source[r["page_id"]], re.S)[1])
        assert r["text"] == " ".join(entities.unescape(re.sub(r"<[^>]+>", " ", body)).split())


def test_neighbours_decide_open_blocks():
    assert html_text.second_pass([None, True, None, None, None, False, None], [False] * 7) == [True, True, True, True, False, False, False]
    assert html_text.second_pass([None, None], [True, False]) == [True, False] and html_text.second_pass([], []) == []


def test_pages_without_known_words():
    """Short paragraphs only, other languages and scripts, tables and code, beside a menu of links."""
    text = html_text.main_text
    menu = "<div><a href=1>Start</a> <a href=2>Kontakt i inne strony tego serwisu dla czytelników</a></div>"
    short = ["The cat sat on the mat.", "It was a sunny day in the garden and the birds sang.", "Then it rained."]
    assert text("<body>" + "".join(f"<div>{x}</div>" for x in short)) == " ".join(short)
    assert text("<body>" + menu + "".join(f"<div>{x}</div>" for x in short)) == " ".join(short)
    polish = "Wczoraj wieczorem wiatr przewrócił stare drzewo przy drodze, więc strażacy przyjechali bardzo szybko i usunęli gałęzie z jezdni. " * 2
    chinese = "昨天晚上大风吹倒了路边的一棵老树消防员很快赶到现场清理了道路上的树枝交通随后恢复正常" * 4
    for said in (polish.strip(), chinese):
        assert text(f"<body>{menu}<div>{said}</div><div>{said}</div></body>") == f"{said} {said}"
    prose = ("The cat sat on the mat and it was happy with the sun in the garden. " * 3).strip()
    code = "for row in range(10): print(row, total[row], limit[row], share[row])"
    assert text(f"<body>{menu}<div>{prose}</div><pre>{code}</pre><div>Short end.</div></body>") == f"{prose} {code} Short end."


def test_transducers():
    s = lambda x: "".join(toxicity.compose(list(x)))
    assert s("oNoIo") == "oNoio" and s("NooooI") == "NooooI" and s("ToI") == "ToJ" and s("IooT") == "JooT"
    assert s("RoI") == "Ror" and s("NTI") == "NTj" and s("VooT") == "KooT" and s("NVT") == "NvT" and s("") == ""


def test_negated_and_reported_insults_say_nothing(spark):
    said = ["You are an idiot", "You are not an idiot", "He said you are an idiot", "She said: \"you idiot\". You are stupid!", "I will kill you", "I will never kill you"]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.with_scores(docs, toxicity.DEFAULT).collect()}
    assert [scores[i] >= 0.5 for i in range(len(said))] == [True, False, False, True, True, False]


def test_long_texts_are_scored_in_one_pass(spark):
    automaton = toxicity._automaton(toxicity.DEFAULT.stems)
    clause = "he saw the stupid dog and went on without a stop , "
    assert toxicity.clause_evidence(clause * 20000 + ". you idiot.", automaton)[toxicity.OUTPUTS.index("J")] == 2.0
    start = time.perf_counter()
    toxicity.clause_evidence("you are stupid. " * 60000, automaton)
    assert time.perf_counter() - start < 20


def test_toxicity_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = toxicity.toxicity_scores(docs, labels)
    rows = scored.join(labels, "doc_id").filter("held_out").select("toxic", "predicted").collect()
    right = sum(r["toxic"] == r["predicted"] for r in rows)
    caught = sum(r["predicted"] for r in rows if r["toxic"]) / sum(r["toxic"] for r in rows)
    wrong = sum(r["predicted"] for r in rows if not r["toxic"]) / sum(1 - r["toxic"] for r in rows)
    assert right >= 0.97 * len(rows) and caught >= 0.8 and wrong <= 0.01


def test_toxicity_odd_rows(spark):
    docs = odd(spark, extra=True).unionByName(spark.createDataFrame([(77, "You are an idiot, said nobody.", "en", "s", 1)], SCHEMA).selectExpr("*", *[f"'x' as {c}" for c in ("score", "kept", "size", "digest", "component_id", "copies")]))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd_labels = spark.createDataFrame([(1, 1, None), (None, 1, 1), (1, 1, 0), (1, 1, 1), (2, 0, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, odd_labels):
        rows = toxicity.toxicity_scores(docs, labels).collect()
        assert len(rows) == 13 and all(0 <= r["score"] <= 1 for r in rows)
        assert [r["doc_id"] for r in rows if r["predicted"]] == [77]
        kept = toxicity.drop_toxic(docs, labels)
        assert kept.columns == docs.columns and kept.count() == 12
    assert toxicity.toxicity_scores(docs.limit(0), none).count() == 0
