import hashlib
import math
import random
import re
import time
from collections import Counter

from ontoloom.llm import pii, queries, secrets, warc, winnow
from tests.llm.edge import empty, frame, rows


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_pii(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def plain_secrets(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def noise(rnd, pieces, n):
    return ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 30))) for _ in range(n)]


def test_pii_base_equals_the_patterns():
    rnd = random.Random(6)
    pieces = list("@@..++--  ()_%09aZé日") + ["1.2.3.4", "255", "256", "a@b.co", "4111 1111 1111 1111", "+1 (555) 010-9999", "4111111111111111", ".", "@", "x-y", "0" * 7, "٣", "12"]
    for text in [*noise(rnd, pieces, 6000), "0" * 6000 + ".1.1.1", "a@b@c.de", "+1--", "+12 3"]:
        assert [s for s in pii.spans(text) if s[0] in pii.BASE] == plain_pii(text), repr(text)


def test_pii_adds_spans():
    text = "See https://u.example.org/x?y=1. IBAN: DE89 3704 0044 0532 0130 00, account no 12345678; 12 Upper Mill Street, Ünï@x"
    found = {k: text[a:b] for k, a, b in pii.spans(text)}
    assert found["url"] == "https://u.example.org/x?y=1"
    assert found["address"] == "12 Upper Mill Street"
    assert [text[a:b] for k, a, b in pii.spans(text) if k == "account"] == ["DE89 3704 0044 0532 0130 00", "12345678"]


def test_pii_urls_equal_a_pattern():
    rnd = random.Random(16)
    pieces = ["http://", "HTTPS://", "ftp://", "mailto:", "a", "x.y", "/p?q=1", ".", ",", ")", " ", "\n", "<", "'", "é", "http:/", "!?"]
    pattern = re.compile(r"""(http://|https://|ftp://|mailto:)([^ \t\n\r\x0b\x0c<>"'`{}|\\^]+)""", re.I | re.A)
    for text in noise(rnd, pieces, 4000):
        want = [(m.start(), m.end(1) + len(body)) for m in pattern.finditer(text) if (body := m[2].rstrip(".,;:!?)"))]
        assert [(a, b) for k, a, b in pii.spans(text) if k == "url"] == want, repr(text)


def test_scans_take_time_in_proportion_to_a_text():
    began = time.time()
    for piece in ("http://", "mailto:x", "ssn1-", "iban 1-", "a@", "+1 ", "1.", " street"):
        text = piece * (1_000_000 // len(piece))
        assert isinstance(pii.spans(text), list)
    secrets.spans("token=" * 170_000)
    assert time.time() - began < 60


def test_secrets_battery():
    rnd = random.Random(9)
    for alphabet in secrets.ALPHABETS:
        p = [secrets.battery_p("".join(rnd.choices(alphabet, k=48)), alphabet) for _ in range(400)]
        assert sum(x < 0.05 for x in p) < 44 and sum(x < 0.5 for x in p) > 100  # close to uniform under its own hypothesis
        if len(alphabet) > 10:
            found = sum(any(k == "random" for k, *_ in secrets.spans("a " + "".join(rnd.choices(alphabet, k=32)) + " b")) for _ in range(200))
            assert found >= 180, alphabet
    for word in ("internationalizationandlocalization", "this-is-a-long-slug-about-nothing", "0" * 40, "abcabcabcabcabcabcabcabcabc", "2021-01-01-2021-01-02-2021", "THISISALLUPPERCASETEXTWITHOUTSPACES"):
        assert all(k != "random" for k, *_ in secrets.spans(word)), word


def test_secrets_random_equals_a_plain_version():
    """The bound of each candidate by direct formulas, and Benjamini-Hochberg by trying every cut."""
    rnd = random.Random(10)
    for _ in range(60):
        words = ["".join(rnd.choices(rnd.choice(secrets.ALPHABETS), k=rnd.randint(20, 40))) for _ in range(rnd.randint(1, 5))] + ["pneumonoultramicroscopicsilico"]
        text, p = " ".join(words), {}
        for w in words:
            alphabet = min((a for a in secrets.ALPHABETS if all(c in a for c in w)), key=len)
            v = [alphabet.index(c) for c in w]
            three = secrets.chi_squared_p(w, alphabet), secrets.runs_p(v, len(alphabet)), secrets.serial_p(v)
            s = -math.log(math.prod(three)) if min(three) else math.inf
            battery = math.exp(-s) * (1 + s + s**2 / 2) if s < math.inf else 0
            if battery >= 1e-3:
                ratio = math.prod(1 / len(alphabet) / secrets.TEXT[c] for c in w) * battery
                p[w] = min(1, len(secrets.ALPHABETS) / ratio)
        cut = max((k for k in range(len(p) + 1) if sum(x <= 0.01 * k / len(words) for x in p.values()) >= k), default=0)
        want = {w for w, x in p.items() if x <= 0.01 * cut / len(words)}
        assert {text[a:b] for k, a, b in secrets.spans(text) if k == "random"} == want


def test_pii_and_secret_queries(spark):
    small = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for query, plain, base in ((queries.op3_pii, plain_pii, pii.BASE), (queries.op6_secrets, plain_secrets, secrets.BASE)):
        got = query(spark, small).collect()
        assert len(got) == len(docs)
        total = 0
        for r in got:
            want = plain(docs[r["doc_id"]])
            line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
            assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
            assert {k: r[f"n_{k}"] for k in base} == {k: sum(s[0] == k for s in want) for k in base}
            assert set(line.split(",")) <= set(r["spans"].split(","))
            total += len(want)
        assert total


def test_secrets_base_equals_the_patterns():
    rnd = random.Random(8)
    pieces = ["password", "PassWd", "tok", "token", "ſecret", "api_key", "apiKey", "=", ":", " ", '"', "'", "AKIA", "ABC123", "deadbeef", "0123456789abcdef" * 2, "x", "/+", "é", "\n", "12345678"]
    for text in noise(rnd, pieces, 6000):
        assert [s for s in secrets.spans(text) if s[0] in secrets.BASE] == plain_secrets(text), repr(text)


def test_random_tokens_are_told_from_text():
    rnd = random.Random(9)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    found = sum(any(k == "random" for k, *_ in secrets.spans("key " + "".join(rnd.choice(b64) for _ in range(40)) + " end")) for _ in range(300))
    assert found > 290
    words = ["thereforeandnevertheless", "internationalization_helper", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "abcdefghijklmnopqrstuvwxyzabcdef", "some-long-hyphenated-identifier-name", "01010101010101010101010101"]
    assert not [s for w in words for s in secrets.spans(f"x {w} y") if s[0] == "random"]


def test_scan_edge_cases(spark):
    for f in (pii.find_personal_data, secrets.find_secrets):
        assert Counter(r["doc_id"] for r in f(frame(spark)).collect()) == Counter(r[0] for r in rows())
        assert f(empty(spark)).count() == 0
    masked = pii.mask_personal_data(spark.createDataFrame([(1, "to a@b.co now"), (2, None)], "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in masked.collect()} == {1: "to <email> now", 2: None}


# --- decontamination ----------------------------------------------------------------------------------------------------


def plain_contamination(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for key, text in items:
        w = cut(text)
        for i in range(max(1, len(w) - 12)) if w else ():
            wins.setdefault(tuple(w[i : i + 13]), set()).add("" if key is None else str(key))
    sizes = {len(w) for w in wins}
    out = Counter()
    for i, text in docs:
        w, hit, which = cut(text), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if found := wins.get(tuple(w[a : a + n])):
                    hit |= set(range(a, a + n))
                    which |= found
        out[(i, len(w), len(hit), len(which), hashlib.sha256(",".join(sorted(which)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))] += 1
    return out


def test_contamination_query(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = Counter(tuple(r) for r in queries.op5_winnowing(spark, small).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    assert got == plain_contamination(docs, items)


def test_contamination_edge_cases(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(11)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(n))) for i, n in enumerate([1, 2, 5, 5, 12, 13, 14, 30, 60, 13])]
    items += [(20, None), (21, "--- !"), (None, "Straße é w1"), (22, items[7][1]), (23, "w3 " * 20)]
    docs = []
    for i in range(60):
        t = [rnd.choice(words) + rnd.choice(["", "x", ""]) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            w = rnd.choice([x for _, x in items if x]).split()
            a = rnd.randint(0, len(w))
            at = rnd.randint(0, len(t))
            t[at:at] = w[a : a + rnd.randint(1, 30)]
        docs.append((i, (rnd.choice([" ", ", ", "-"])).join(t).upper() if i % 3 else " ".join(t)))
    docs += [(60, None), (61, ""), (None, items[8][1]), (62, items[8][1]), (62, items[8][1]), (63, "STRASSE é W1"), (64, "Straße É w1 straße é w1"), (65, "w3 " * 3000)]
    got = winnow.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("s"), "contaminated").collect()
    assert Counter(tuple(r) for r in got) == plain_contamination(docs, items)
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in winnow.contamination(frame(spark), none).collect()} == {0}
    assert winnow.contamination(empty(spark), none).count() == 0
    assert winnow.drop_contaminated(frame(spark), none).columns == frame(spark).columns


# --- fixity ---------------------------------------------------------------------------------------------------------------


def test_audit_finds_each_fault(spark):
    schema = "page_id long, url string, html string, level int, shard string"
    good = [(i, f"http://x/{i}", "<p>" + "a" * (i % 50), 1, "s") for i in range(0, 9000, 7)] + [(3, "http://x/3", None, 1, "s"), (None, "http://x/none", "b", 1, "s"), (14, "http://x/14", "again", 1, "s")]
    bad = [r for r in good if r[0] != 70]
    bad = [(r[0], r[1], "Z" + (r[2] or "")[1:], 1, "s") if r[0] == 4900 else r for r in bad] + [(5000, "http://new", "n", 1, "s")]
    damage, visited = warc.audit(spark.createDataFrame(good, schema), spark.createDataFrame(bad, schema))
    rows = {r["page_id"]: r for r in damage.collect()}
    assert {(k, r["state"], r["copies"]) for k, r in rows.items()} == {(70, "missing", 1), (4900, "damaged", 1), (5000, "extra", 1)}
    # a lost record moves all later ones of its shard, and still no node but those above it differs
    assert {r["level"]: r["differing"] for r in visited.collect()} == {3: 2, 2: 2, 1: 3, 0: 3}  # slots 804 and 904 share a node of level 2
    before = [r for r in good if r[0] is not None and r[0] < 70]
    size = lambda r: len(f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {r[1]}\r\nContent-Type: text/html\r\nContent-Length: {len(r[2] or '')}\r\n\r\n{r[2] or ''}\r\n\r\n")
    assert rows[70]["start"] == sum(map(size, before))
    same, looked = warc.audit(spark.createDataFrame(good, schema), spark.createDataFrame(good, schema))
    assert same.count() == 0
    levels = {r["level"]: r["compared"] for r in looked.collect()}
    assert levels[warc.LEVELS] >= 3 and levels[0] == 0
    nothing = spark.createDataFrame([], schema)
    assert warc.audit(nothing, nothing)[0].count() == 0
    assert warc.audit(spark.createDataFrame(good[:5], schema), nothing)[0].count() == 5


def test_audit_of_repeated_keys(spark):
    """Records of one key cancel by content: a lost copy is one missing record, several changed ones are missing and extra."""
    schema = "page_id long, url string, html string, start long, over long"
    good = [(7, "u", "same", 1, 1)] * 500 + [(7, "u", f"own {i}", 1, 1) for i in range(20)] + [(None, None, None, None, None)] * 30
    bad = [(7, "u", "same", 1, 1)] * 498 + [(7, "u", f"own {i}" if i > 1 else f"new {i}", 1, 1) for i in range(20)] + [(None, None, None, None, None)] * 30
    damage, _ = warc.audit(spark.createDataFrame(good, schema), spark.createDataFrame(bad, schema))
    found = sorted((r["state"], r["copies"]) for r in damage.collect())
    assert found == [("extra", 1), ("extra", 1), ("missing", 1), ("missing", 1), ("missing", 2)]
    one = [(*r[:2], "own 3!", 1, 1) if r[2] == "own 3" else r for r in good]
    damage, _ = warc.audit(spark.createDataFrame(good, schema), spark.createDataFrame(one, schema))
    assert [(r["page_id"], r["state"]) for r in damage.collect()] == [(7, "damaged")]


def test_secrets_behind_names_and_in_paths():
    """Nine of ten random tokens are found wherever they stand; the text around them is not."""
    rnd = random.Random(21)
    frames = ("{}", "MY_KEY={}", "export DB_PASS_1='{}'", "https://host.example.com/v1/{}", "https://host.example.com/get?sig={}&x=1", "x/{}", "static-assets/images/{}", '{{"k": "{}"}}', "A=1;B={}==")
    for alphabet in secrets.ALPHABETS:
        for shape in frames:
            hits = 0
            for _ in range(60):
                token = "".join(rnd.choices(alphabet, k=40)).strip("-_")
                text = "see " + shape.format(token) + " here"
                at = text.index(token)
                hits += any(k == "random" and a < at + len(token) and b > at for k, a, b in secrets.spans(text))
            assert hits >= 54, (alphabet, shape, hits)
    plain = "NAME_OF_THE_SETTING=some-plain-value-of-words path/to/a/directory/with/a/long/name/in/it README-for-developers-and-users=yes==no"
    assert not [s for s in secrets.spans(plain + " A_B=" + "x" * 60) if s[0] == "random"]


def test_secret_parts_do_not_overlap_their_whole():
    rnd = random.Random(22)
    for _ in range(100):
        word = "".join(rnd.choices(secrets.ALPHABETS[-2], k=60)) + "/" + "".join(rnd.choices(secrets.ALPHABETS[1], k=30))
        found = [(a, b) for k, a, b in secrets.spans(word) if k == "random"]
        assert all(b <= a2 for (_, b), (a2, _) in zip(found, found[1:], strict=False)) and found
