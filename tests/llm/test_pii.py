"""Replacements: types, formats, coreference, distinctness, untouched rest."""

import re

from pyspark.sql import functions as F

from stockspark.llm import pii

TEXT = ("Mr. John Smith and Mrs Anna Lee met Herr Müller and Госпожа Анна Иванова; JOHN.doe5@Corp.Example.org, "
        "john.doe5@corp.example.org, +1 (743) 555-3824, +1-743-555-3824, +49 30 1234567; 123-45-6789; "
        "4111 1111 1111 1111 or 4111111111111111, not 1234567812345678; 10.0.0.7 and 8.8.8.8 not 999.1.1.1; "
        "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" v1.2.3 2.0.")
ROWS = [(1, TEXT, "a", "k"), (2, None, "b", "k"), (3, "", None, "k"), (4, "nothing here", "", "k"), (1, TEXT, "a", "k"),
        (None, "call +1 (743) 555-3824 " * 3000, "c", "k"), (5, "8.8.8.8", "d", "k"), (6, "Password: 'abcdefghijklmnopqrst'", "e", "k")]
SCHEMA = "doc_id long, text string, found string, key string"


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_replacements(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = pii.replace_pii(docs)
    assert out.columns == [*docs.columns, "n_entities"]
    rows = out.collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[2].text is None and by[3].text == "" and by[4].text == "nothing here" and by[4].n_entities == 0
    assert [r.text for r in rows if r.doc_id == 1][0] == [r.text for r in rows if r.doc_id == 1][1]
    new = by[1].text
    for old in ("John Smith", "Anna Lee", "Müller", "Иванова", "JOHN.doe5", "555-3824", "123-45-6789", "4111", "10.0.0.7",
                "8.8.8.8", "24be64439e"):
        assert old not in new
    for kept in ("1234567812345678", "999.1.1.1", "v1.2.3 2.0.", "token = \"", " met "):
        assert kept in new
    shape = re.fullmatch(
        r"Mr\. (\w+ \w+) and Mrs (\w+ \w+) met Herr (\w+) and Госпожа ([А-я]+ [А-я]+); ([A-Z]{4}\.[a-z]{3}\d@\w+\.\w+\.org), "
        r"([a-z]{4}\.[a-z]{3}\d@\w+\.\w+\.org), \+1 \((\d{3})\) (\d{3}-\d{4}), \+1-(\d{3})-(\d{3}-\d{4}), \+49 \d\d \d{7}; "
        r"\d{3}-\d\d-\d{4}; (\d{4} \d{4} \d{4} \d{4}) or (\d{16}), not 1234567812345678; (10\.\d+\.\d+\.\d+) and ([\d.]+) "
        r"not 999\.1\.1\.1; token = \"[0-9a-f]{40}\" v1\.2\.3 2\.0\.", new)
    assert shape
    g = shape.groups()
    assert g[4].lower() == g[5]                                   # one address, two spellings
    assert (g[6], g[7]) == (g[8], g[9])                           # one number, two formats
    assert g[10].replace(" ", "") == g[11] and luhn(g[11]) and g[11][0] == "4"
    assert g[0].split()[0] in pii.FIRST["latin", "m"].split() and g[1].split()[0] in pii.FIRST["latin", "f"].split()
    assert g[3].split()[0] in pii.FIRST["cyrillic", "f"].split() and g[3].endswith("ова")
    assert re.fullmatch("Password: '[a-z]{20}'", by[6].text) and "abcdefgh" not in by[6].text
    assert by[5].text == g[13]                                    # the same everywhere
    long = by[None]
    assert long.n_entities == 3000 and len(set(re.findall(r"\+1 \(\d+\) [\d-]+", long.text))) == 1


def test_surrogates_are_distinct(spark):
    """More entities than a small space holds without collisions."""
    ips = [f"192.168.{i // 200}.{i % 200}" for i in range(3000)]
    found = spark.createDataFrame([("ip", x) for x in ips] * 2, "kind string, form string")
    got = pii.surrogates(found).collect()
    assert len(got) == 3000 and len({r.surrogate for r in got}) == 3000
    assert not {r.surrogate for r in got} & set(ips)
    assert all(r.surrogate.startswith("192.168.") for r in got)


def test_keyed_and_native(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    one, other = (pii.replace_pii(docs, k).where("doc_id = 5").first().text for k in ("a", "b"))
    assert one != other
    plan = pii.replace_pii(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert pii.replace_pii(docs.limit(0)).count() == 0
    assert pii.replace_pii(docs.where(F.col("doc_id") == 4)).first().text == "nothing here"


def test_entities_that_draws_cannot_replace(spark):
    """Punctuation-only placeholders stay, other scripts are replaced; no row is lost."""
    texts = ['password: "----------------" x', "secret = '________________'", "用户@公司.中国 und", "--@-.com",
             "कमल@घर.कमल", "مرحبا@شركة.مصر", "8.8.8.8"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = {r.doc_id: r for r in pii.replace_pii(docs).collect()}
    assert len(by) == len(texts)
    for i in (0, 1, 3):
        assert by[i].text == texts[i] and by[i].n_entities == 0
    for i in (2, 4, 5, 6):
        assert by[i].text != texts[i] and by[i].n_entities == 1
    assert re.fullmatch(r"[一-鿿]{2}@[一-鿿]{2}\.中国 und", by[2].text)


def test_dense_space_is_permuted(spark, monkeypatch):
    """More than half of a private range, and all values of another space."""
    monkeypatch.setattr(pii, "MAX_DRAWS", 2)
    ips = [f"192.168.{i // 254 + 1}.{i % 254 + 1}" for i in range(60000)]
    mails = [f"{c}@x.org" for c in "abcdefghijklmnopqrstuvwxyz"]
    found = spark.createDataFrame([("ip", x) for x in ips] + [("email", x) for x in mails], "kind string, form string")
    got = pii.surrogates(found).collect()
    assert len(got) == 60026 and len({(r.kind, r.surrogate) for r in got}) == 60026
    assert all(r.surrogate != r.form for r in got)
    assert all(re.fullmatch(r"192\.168\.\d+\.\d+" if r.kind == "ip" else r"[a-z]@[a-z]\.org", r.surrogate) for r in got)


def test_usual_forms(spark):
    """Long, dotted and bare secrets, national phone numbers; prose and code stay."""
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N"
    texts = [f'secret = "{"k3" * 90}"', f'token: "{jwt}"', "password=abcdefgh12345678 next", f"api_key: {jwt}, end",
             "call (663) 555-6869 now", "call 663-555-6869 now", "+1 663 555 6869", "663.555.6869."]
    kept = ["token = getAccessTokenFromRequest(x)", "order 1663-555-68690", "password: short1", "id 663-555-6869-12"]
    docs = spark.createDataFrame(list(enumerate(texts + kept)), "doc_id long, text string")
    by = {r.doc_id: r for r in pii.replace_pii(docs).collect()}
    for i, t in enumerate(texts):
        assert by[i].n_entities == 1 and by[i].text != t and len(by[i].text) == len(t), t
        assert re.sub(r"\w", "x", by[i].text) == re.sub(r"\w", "x", t)
    assert all(by[len(texts) + i].text == t for i, t in enumerate(kept))
    assert "abcdefgh" not in by[2].text and by[2].text.endswith(" next") and by[3].text.endswith(", end")
    assert len({re.sub(r"\D", "", by[i].text)[-10:] for i in (4, 5, 6, 7)}) == 1      # one number, four formats


def test_clashing_column_names(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.org now", 7, "f", "k"), (2, "nothing", 8, "f", "k"), (3, None, 9, "f", "k")],
                                 "doc_id long, text string, N_Entities int, found string, `key` string")
    out = pii.replace_pii(docs)
    assert out.columns == [*docs.columns, "n_entities_"]
    by = {r.doc_id: r for r in out.collect()}
    assert [by[i].N_Entities for i in (1, 2, 3)] == [7, 8, 9] and [by[i].n_entities_ for i in (1, 2, 3)] == [1, 0, 0]
    assert by[1].text != "mail a.b@c.org now" and by[2].text == "nothing" and by[3].text is None


def test_numbers_of_no_issuer_are_no_cards(spark):
    """Long numbers that only happen to have a valid check digit stay."""
    cards = ["4444333322221111", "5555555555554444", "2223003122003222", "378282246310005", "30569309025904",
             "6011111111111117", "3566002020360505", "6200000000000005", "4222222222222"]
    others = ["0810992847249404", "1232810148878564", "7755680307517467", "8894160621567258", "9656005089711094",
              "3417310086869215"]
    texts = dict(enumerate(f"number {n} here" for n in cards + others))
    by = {r.doc_id: r for r in pii.replace_pii(
        spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}

    def luhn(d):
        d = [int(c) for c in d][::-1]
        return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10
    for i, n in enumerate(cards + others):
        assert luhn(n) == 0
        new = re.sub("[^0-9]", "", by[i].text)
        if n in others:
            assert by[i].text == texts[i] and by[i].n_entities == 0, n
        else:
            assert by[i].n_entities == 1 and new != n and len(new) == len(n) and new[0] == n[0] and luhn(new) == 0, n
