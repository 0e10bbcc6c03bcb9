"""Base spans against Python's regular expressions, and the invariants of added spans and redaction."""

import hashlib
import random
import re

from tilewright.llm import entry, pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute(text: str) -> dict[str, list[tuple[int, int]]]:
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out[kind].append((m.start(), m.end()))
    return out


def rows(spark, sf_dir):
    rng = random.Random(3)
    pool = ["a@b.c", "x.y%z@q-r.st.uv", "@", "a@b", "a@b..c", "1.2.3.4", "256.1.1.1", "0001.2.3.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (443) 555-5793", "+49 30 123456", "+1", "(443) 555-5793", "é", "😀", "\x01", "\x02", " ", ".", "-", "%w@e.f", "123456789012", "0", "\n", "::1", "fe80:1:2:3", "A"]
    made = ["".join(rng.choice(pool) for _ in range(rng.randrange(14))) for _ in range(600)]
    made += ["", "a" * 50_000, "1" * 50_000, "a@" + "b." * 20_000 + "c", "+1" + " " * 50_000, "1.2." * 4000, "x" * 10 + "@y.z" * 1000]
    spark_rows = [(i, t) for i, t in enumerate(made)] + [(None, None), (3, "a@b.c"), (3, "a@b.c")]
    return spark.createDataFrame(spark_rows, "doc_id long, text string").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def test_base_spans_and_digests(spark, sf_dir):
    docs = rows(spark, sf_dir)
    for r in pii.find(docs, ("doc_id", "text")).collect():
        want = brute(r.text or "")
        for kind in pii.KINDS:
            assert [tuple(s) for s in r[kind]] == want[kind], (kind, (r.text or "")[:80])
            every = [tuple(s) for s in r[f"{kind}_all"]]
            assert set(want[kind]) <= set(every) and every == sorted(every)
            added = [s for s in every if s not in want[kind]]
            assert not [1 for a, b in added for c, d in want[kind] if a < d and c < b]
    digests = {(r.doc_id, r.base_sha256) for r in entry.pii_digests(docs).collect()}
    for r in docs.collect():
        text = ",".join(f"{k}:{a}:{b}" for k, spans in brute(r.text or "").items() for a, b in spans)
        assert (r.doc_id, hashlib.sha256(text.encode()).hexdigest()) in digests
    assert entry.pii_digests(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = entry.op5_pii(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail é a@b.co now 1.2.3.4!", 5, "k"), (2, None, 0, None), (3, "clean", 5, "k"), (4, "+1 (843) 555-7672 170.106.47.218 x", 3, "")], "doc_id long, text string, n_chars long, start string")
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert out[1].text == "mail é [EMAIL] now [IP]!" and out[1].n_chars == len(out[1].text) and out[1].start == "k"
    assert out[2].text is None and out[3].text == "clean" and out[3].n_chars == 5
    assert out[4].text == "+1 (843) 555-7672 [IP] x"  # 23 digits are no phone number
    assert pii.redact(docs).columns == docs.columns


def test_octets_of_zeros(spark):
    pool = ["10.0.0.1", "192.168.0.1", "127.0.0.1", "0.0.0.0", "00.1.2.3", "000.00.0.0", "0255.0.010.099", "256.0.0.1", "1.0.0.256", "0.0300.0.1", "0" * 4000 + ".0.0.1", "0" * 4000 + "256.0.0.1"]
    made = [*pool, *[f"é {a} and {b}, x" for a in pool for b in pool[:8]]]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for r in pii.find(docs, ("doc_id", "text")).collect():
        assert [tuple(s) for s in r.ip] == brute(r.text)["ip"], r.text[:80]
    assert [brute(t)["ip"] != [] for t in pool] == [True] * 7 + [False] * 3 + [True, False]
    text = spark.createDataFrame([(1, "host 10.0.0.1 up", 16)], "doc_id long, text string, n_chars long")
    assert pii.redact(text).first().text == "host [IP] up"


def test_trees_learn_from_sure_ones_and_find_others(spark):
    """Tokens after a cue teach what a secret looks like; ones of the same form are found, words and numbers are not."""
    rng = random.Random(6)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(18)) + "a1"
    made = [f"say token={key()} now" for _ in range(300)] + [f"mail me a{i} (at) host (dot) org today" for i in range(100)] + [f"plain words number {i} and some-long-word-x{i % 3} there" for i in range(300)]
    docs = spark.createDataFrame([(i, t, len(t), "v") for i, t in enumerate(made)], "doc_id long, text string, n_chars long, `a.b` string")
    rows = {r.doc_id: r for r in pii.find(docs).collect()}
    assert all(made[i][r.secret_all[0].start : r.secret_all[0].end] == made[i][10:30] and len(r.secret_all) == 1 for i, r in rows.items() if i < 300)
    assert all(made[i][r.email_all[0].start : r.email_all[0].end].startswith("a") for i, r in rows.items() if 300 <= i < 400)
    assert not any(r[f"{k}_all"] for i, r in rows.items() if i >= 400 for k in pii.ALL_KINDS)
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert out[0].text == "say token=[SECRET] now" and out[0]["a.b"] == "v" and out[300].text == "mail me [EMAIL] today" and out[450].text == made[450]


def test_many_matches_in_one_text(spark):
    text = "x 1.2.3.4 " * 700 + "a@b.c, " * 600
    docs = spark.createDataFrame([(1, text), (2, "1.2.3.4 " * 255 + "5.6.7.8"), (3, "1.2.3.4 " * 256)], "doc_id long, text string")
    for r in pii.find(docs, ("text",)).collect():
        assert {k: [tuple(s) for s in r[k]] for k in pii.KINDS} == brute(r.text)


def test_sure_spans_are_found_in_tables_of_any_size(spark):
    rows = [(1, 'token = "04db61fe2a77c9015b3d"'), (2, "write to ann (at) example (dot) org"), (3, "plain text"), (4, "tel: 443 555 5793"), (5, "order 1234567 of 2024-01-02")]
    for n in (1, 5):
        docs = spark.createDataFrame(rows[:n], "doc_id long, text string")
        got = {r.doc_id: r.spans for r in entry.pii_digests(docs).collect()}
        assert got[1] == "secret:9:29"
    assert got[2] == "email:9:35" and got[3] == "" and got[4] == "phone:5:17" and got[5] == ""
    assert [r.text for r in pii.redact(docs).orderBy("doc_id").collect()][0] == 'token = "[SECRET]"'


def test_trees_learn_from_context_and_leave_look_alikes(spark):
    """Keys after a cue teach that quoted long hexadecimal runs are secrets; order codes are candidates that are not."""
    rng = random.Random(7)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"
    rows = [f'token = "{hexa(40)}"' for _ in range(400)] + [f"order {hexa(10).upper()} shipped" for _ in range(300)] + [f"version v{rng.randrange(9)}x{hexa(8)}" for _ in range(150)]
    rows += [f'blob = "{hexa(40)}"' for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    models = pii.fit(docs)
    used = {f for t in models["secret"].trees for f in (t[0], t[2][0], t[3][0])}
    assert used and models["secret"].threshold is not None
    got = {r.doc_id: r.spans for r in entry.pii_digests(docs).collect()}
    found = [k for k, spans in got.items() if "secret" in spans]
    assert {*range(400), 850, 851} == {*found}
