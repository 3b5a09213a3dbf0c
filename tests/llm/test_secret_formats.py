import random

from quillframe.llm import secret_scan
from quillframe.llm.queries import labelled_findings

HEX = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"


def test_assigned_values_of_any_characters_are_candidates():
    for value in ("p.ss!w0rd#xyz", "correcthorsebattery", "Zm9vYmFy+/x9Qw==", "eyJhbGciOiJIUzI1.eyJzdWIiOiIx.c2lnbmF0dXJl", "pässwörter!"):
        for text in (f'é password = "{value}" x', f"é password: {value} x"):
            raw = text.encode()
            assert [raw[a:b].decode() for a, b in secret_scan.find_candidates(raw)] == [value], text


def test_labels_and_planted_secrets_in_other_formats(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    model = secret_scan.fit_text_model(docs)
    found = labelled_findings(secret_scan.candidates(docs, model)).cache()
    assert {r["label"] for r in found.where(f"candidate = '{HEX}'").select("label").collect()} == {1}
    rnd = random.Random(2)
    value = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    plants = [value("0123456789ABCDEF", 40) for _ in range(20)] + [value(b64, 32) + "==" for _ in range(20)]
    rows = [(i, f'the value of\ntoken = "{p}" and more') for i, p in enumerate(plants)]
    got = labelled_findings(secret_scan.candidates(spark.createDataFrame(rows, "doc_id long, text string"), model))
    assert {r["label"] for r in got.where("doc_id >= 20").select("label").collect()} == {None}
    caught = secret_scan.judge(got, secret_scan.fit_forest(found)).where("secret").count()
    assert caught >= 38
    found.unpersist()


ORDINARY = ['author = "Jonathan Swift"', "url: https://example.org/index.html", 'encoding = "application/json"', "module = 'numpy.linalg.solve'", "path=/usr/local/bin/python",
            'version: "2.13.4-release"', 'title = "The quick brown fox"', "password: required", 'token = "identifier"', "key: primary_key_column", 'license = "Apache License"',
            "name=quarterly_report.xlsx", "author: Mary-Jane", 'charset = "iso-8859-1"', "host: mail.example.com", 'secret = "confidential"', "city = Wolverhampton",
            "access: read-only-users", 'label = "Neue Bilder"', "format = yyyy-mm-dd"]


def test_ordinary_assignments_and_secrets_are_told_apart(spark):
    """Neither list stands in the training rows; the tables hold hexadecimal secrets and no ordinary assignments."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    model = secret_scan.fit_text_model(docs)
    labelled = labelled_findings(secret_scan.candidates(docs, model)).select("candidate", "start", "label", *secret_scan.FEATURES)
    forest = secret_scan.fit_forest(labelled.unionByName(secret_scan.drawn_assignments(docs, model)))
    rnd = random.Random(9)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    kinds = [("0123456789abcdef", 40), ("0123456789ABCDEF", 32), (b64, 36), (b64, 24), ("abcdefghijklmnopqrstuvwxyz0123456789", 30)]
    plants = [f'{name} = "{"".join(rnd.choice(letters) for _ in range(n))}"' for letters, n in kinds for name in ("token", "password", "client", "API_KEY")]
    rows = list(enumerate(plants + ORDINARY))
    told = secret_scan.judge(secret_scan.candidates(spark.createDataFrame(rows, "doc_id long, text string"), model), forest).where("secret")
    said = {r["doc_id"] for r in told.select("doc_id").collect()}
    right = len({d for d in said if d < len(plants)})
    assert right >= 0.9 * len(plants) and right >= 0.9 * len(said), sorted(dict(rows)[d] for d in said ^ set(range(len(plants))))


def test_tables_without_rows_or_labels(spark):
    for rows in ([], [(1, None)], [(1, "plain words only"), (2, 'name = "Jonathan Swift"')]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        model = secret_scan.fit_text_model(docs)
        found = labelled_findings(secret_scan.candidates(docs, model)).select("doc_id", "candidate", "start", "label", *secret_scan.FEATURES)
        rules = found.drop("doc_id").unionByName(secret_scan.drawn_assignments(docs, model))
        got = secret_scan.judge(found, secret_scan.fit_forest(rules)).collect()
        assert [(r["doc_id"], r["probability"], r["secret"]) for r in got] == [(2, 0.0, False)] * (len(rows) == 2)
