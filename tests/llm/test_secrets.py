import random

import numpy as np
import pytest

from colsight.llm import secrets
from colsight.llm.secrets import CharNet, base_spans, candidates, look, redacted, scan_secrets, train
from tests.llm.conftest import ODD, rows_of

rnd = random.Random(8)


@pytest.fixture(autouse=True)
def same_texts():
    rnd.seed(8)


def hexes(n):
    return "".join(rnd.choice("0123456789abcdef") for _ in range(n))


def test_patterns():
    text = 'TOKEN = "abcdef" x secret:abc api_key=longenough apikey = \'k1234567\' AKIA' + "Z" * 16 + " " + "0" * 24 + " AKIAshort"
    kinds = [(text[a:b], k) for a, b, k in base_spans(text)]
    assert kinds == [
        ('TOKEN = "abcdef', "assign"), ("api_key=longenough", "assign"), ("apikey = 'k1234567", "assign"),
        ("AKIA" + "Z" * 16, "access"), ("0" * 24, "hex"),
    ]


def test_a_failing_match_hides_what_it_covers():
    assert base_spans("secret=token:abcdefgh") == []
    assert base_spans("toKen=abcdefgh ſecret=abcdefgh") == []


def test_places_count_code_points():
    assert base_spans("漢é password=hunter22") == [(3, 20, "assign")]


def test_candidates_know_their_matches():
    text = f"key {hexes(30)} and order 1234567890123456 or plainlongwordwithoutdigits"
    assert [known for _, _, known in candidates(text, base_spans(text))] == [True, False]


def test_look_has_one_size():
    for text, a, b in (("x", 0, 1), ("ab" * 100, 0, 200), ("pre " + "k" * 33 + " post", 4, 37), ("é" * 50, 10, 30)):
        assert len(look(text, a, b)) == secrets.WINDOW


def test_gradients_as_differences():
    rng = np.random.default_rng(0)
    net = CharNet.fresh(rng, depth=3, width=3, filters=4)
    codes, labels = rng.integers(0, 128, (6, 20)), np.array([0, 1, 0, 1, 1, 0.0])

    def loss():
        z = net.logits(codes)
        return np.mean(np.logaddexp(0, z) - labels * z)

    for name, slope in zip(("table", "kernel", "shift", "weights"), net.gradients(codes, labels)):
        array = getattr(net, name)
        place = np.unravel_index(np.abs(slope).argmax(), array.shape)
        array[place] += 1e-6
        high = loss()
        array[place] -= 2e-6
        low = loss()
        array[place] += 1e-6
        assert abs((high - low) / 2e-6 - slope[place]) < 1e-5


def some_texts(count):
    rows = []
    for k in range(count):
        words = ["".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 12))) for _ in range(30)]
        words[10] = [f"password={hexes(18)}", f'token = "{hexes(40)}"', f"{rnd.randrange(10**15, 10**16)}"][k % 3]
        rows.append((k, " ".join(words)))
    return rows


def test_held_out_recall_meets_the_constraint():
    found = [secrets._scanned(t)[1] for _, t in some_texts(300)]
    looks = [f["look"] for fs in found for f in fs]
    labels = [f["role"] == "secret" for fs in found for f in fs]
    judge = train(looks[:-200], labels[:-200], recall=0.95, precision=0.97)
    scores = judge.scores(secrets.coded(looks[-200:]))
    truth = np.array(labels[-200:])
    assert (scores[truth] >= judge.threshold).mean() >= 0.9
    assert (scores[~truth] >= judge.threshold).mean() <= 0.05


def test_adds_what_looks_like_a_secret_and_keeps_the_matches(documents):
    rows = some_texts(240)
    new = range(1000, 1006)
    rows += [(k, f"etaoin shr token = <{hexes(19)}g{hexes(20)}> ions that no pattern knows") for k in new]
    got = {r.doc_id: r.spans for r in scan_secrets(documents(rows)).collect()}
    for d, t in rows:
        base = [tuple(s) for s in got[d] if s.kind != "learned"]
        assert base == base_spans(t)
    assert sum([tuple(s) for s in got[k]] == [(20, 60, "learned")] for k in new) >= 4
    numbers = [d for d, _ in rows if d % 3 == 2]
    assert sum(bool(got[d]) for d in numbers) <= 0.1 * len(numbers)


def test_finds_kinds_no_pattern_knows_and_leaves_identifiers_alone(spark, documents):
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    both = lower + lower.upper() + digits
    pick = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    keys = [
        lambda: "ghp_" + pick(both, 36), lambda: "eyJhbGciOiJIUzI1NiJ9" + pick(both + "-_", 60),
        lambda: pick(both, 15) + "7", lambda: pick(lower + lower.upper(), 24), lambda: pick(lower.upper() + "234567", 32),
    ]
    harmless = [
        lambda: "_".join(rnd.choices(["customer", "region", "amount", "total"], k=4)), lambda: "INV-2024-" + pick(digits, 6),
        lambda: "-".join(pick(digits + "abcdef", n) for n in (8, 4, 4, 4, 12)), lambda: "electroencephalograph",
    ]
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    rows = [(-1 - r.doc_id, r.text) for r in given]
    rows += [(1000 + k, f"the value was {keys[k % 5]()} and then we left") for k in range(100)]
    rows += [(2000 + k, f"the value was {harmless[k % 4]()} and then we left") for k in range(100)]
    got = {r.doc_id: r for r in scan_secrets(documents(rows), judged="judged").collect()}
    assert all(r.judged for r in got.values())
    found = [any(s.kind == "learned" for s in got[1000 + k].spans) for k in range(100)]
    assert sum(found) >= 90
    assert sum(bool(got[2000 + k].spans) for k in range(100)) <= 2
    assert all(s.kind != "learned" for d, _ in rows if d < 0 for s in got[d].spans)


def test_says_when_no_network_judged(documents):
    few = scan_secrets(documents([(1, "token=abcdefgh1234567890"), (2, "order 1234567890123456")]), judged="on")
    assert [(r.doc_id, r.on) for r in few.orderBy("doc_id").collect()] == [(1, False), (2, False)]


def test_every_part_of_a_long_run_is_seen():
    text = "x " + "a" * 100 + "Zq7" + "b" * 100 + " y"
    views = secrets.looks(text, 2, 205)
    own = [v[secrets.CONTEXT:-secrets.CONTEXT].replace(b"\0", b"").decode() for v in views]
    assert all(len(o) == 48 for o in own) and any("Zq7" in o for o in own)
    covered = {i for k, _ in enumerate(own) for i in range(min(24 * k, 155), min(24 * k, 155) + 48)}
    assert covered == set(range(203))
    assert len(secrets.looks("k" * 20, 0, 20)) == 1


def brute_base(text):
    """The contract's patterns again, one character at a time."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    letters = "abcdefghijklmnopqrstuvwxyz"
    body = set(letters + letters.upper() + "0123456789+/_.=-")
    out, at = [], 0
    while at < len(text):
        end = None
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(word, at):
                k = at + len(word)
                k += k < len(text) and text[k] in "\"'"
                while k < len(text) and text[k] == " ":
                    k += 1
                if k < len(text) and text[k] in ":=":
                    k += 1
                    while k < len(text) and text[k] == " ":
                        k += 1
                    k += k < len(text) and text[k] in "\"'"
                    first = k
                    while k < len(text) and text[k] in body:
                        k += 1
                    if k > first:
                        end = k
                        if k - first >= 6:
                            out.append((at, k, "assign"))
                break
        at = end or at + 1
    for kind, head, chars, least in (
        ("access", "AKIA", set(letters.upper() + "0123456789"), 20), ("hex", "", set("0123456789abcdef"), 24)
    ):
        at = 0
        while at < len(text):
            k = at + len(head)
            if text.startswith(head, at) and k < len(text) and text[k] in chars:
                while k < len(text) and text[k] in chars:
                    k += 1
                if k - at >= least:
                    out.append((at, k, kind))
                at = k
            else:
                at += 1
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def test_base_spans_against_brute_force(documents):
    parts = ["token", "API_KEY", "apikey", "passwd", "secret", '"', "'", " ", "=", ":", "abcdef", "AKIA", "Z" * 16, "0" * 23,
             "a1", "é", "漢", "\n", ".", "-x", "ſecret", "K"]
    texts = [(k, "".join(rnd.choices(parts, k=rnd.randint(0, 40)))) for k in range(1500)]
    got = {r.doc_id: [tuple(s) for s in r.spans if s.kind != "learned"] for r in scan_secrets(documents(texts)).collect()}
    for d, t in texts:
        assert got[d] == brute_base(t), t


def test_odd_tables(odd, clashing, documents):
    want = sorted(((d, []) for d, *_ in ODD), key=repr)
    assert rows_of(scan_secrets(odd)) == rows_of(scan_secrets(clashing)) == want
    assert scan_secrets(documents([])).count() == 0
    one = scan_secrets(documents([(1, "token=abcdefgh"), (1, "token=abcdefgh")]))
    assert [[tuple(s) for s in r.spans] for r in one.collect()] == [[(0, 14, "assign")]] * 2


def test_redaction(spark):
    spans = "array<struct<start:bigint,end:bigint,kind:string>>"
    df = spark.createDataFrame(
        [("abcdefgh", [(1, 3, "a"), (2, 4, "b"), (6, 8, "c")]), ("héllo", [(0, 2, "a")]), ("x", []), (None, [])],
        f"text string, spans {spans}",
    )
    got = [r.t for r in df.select(redacted(df.text, df.spans, "_").alias("t")).collect()]
    assert got == ["a_ef_", "_llo", "x", None]


def labelled(spark, count):
    """Findings as the scan labels them, of which every tenth comes twice."""
    rows = []
    for k, text in some_texts(count):
        for f in secrets._scanned(text)[1]:
            rows += [(hash((k, f["start"])), f["look"], f["role"] == "secret", 1 + (k % 10 == 0))]
    return rows, spark.createDataFrame(rows, "draw long, look binary, secret boolean, copies long")


def test_every_labelled_finding_is_in_a_block(spark):
    """No bound on the findings of a label: each is in one block, held out or not."""
    rows, table = labelled(spark, 300)
    blocks = secrets._blocks(table, 40).collect()
    assert len(blocks) > 4
    read = np.concatenate([np.frombuffer(b.rows, secrets._FINDINGS) for b in blocks])
    own = read[~read["made"]]
    assert sorted((f["look"].tobytes(), bool(f["secret"]), int(f["copies"])) for f in own) == sorted(
        (bytes(look), secret, copies) for _, look, secret, copies in rows
    )
    assert sum(sum(b.found) for b in blocks) == len(rows)
    assert 0.15 < own["held"].mean() < 0.26


def test_a_training_goes_through_all_findings():
    net, rng = CharNet.fresh(np.random.default_rng(1)), np.random.default_rng(2)
    seen, codes = set(), np.arange(2 * 128 * secrets.WINDOW).reshape(256, -1) % 250
    labels = np.arange(256) % 2.0
    whole = CharNet.gradients
    net.gradients = lambda c, y, n: seen.update(map(bytes, c.astype(np.uint8))) or whole(net, c, y, n)
    net.fit(codes, labels, 2, rng)
    assert seen == set(map(bytes, codes.astype(np.uint8)))


def test_blocks_averaged_learn_as_one_does(spark):
    rows, table = labelled(spark, 300)
    judge = secrets.train_on_all(table, 0.95, 0.9, 200)
    assert judge.net is not None
    new = [f for _, text in some_texts(200) for f in secrets._scanned(text)[1]]
    scores, truth = judge.scores(secrets.coded([f["look"] for f in new])), np.array([f["role"] == "secret" for f in new])
    assert (scores[truth] >= judge.threshold).mean() >= 0.9
    assert (scores[~truth] >= judge.threshold).mean() <= 0.05


def test_repeated_findings_count_in_calibration_and_threshold():
    scores, copies = np.array([0.9, 0.8, 0.7, 0.1]), np.array([1.0, 1, 1, 97])
    assert secrets._reaching(scores, 0.95, copies) == 0.1
    assert secrets._reaching(scores, 0.03, copies) == 0.7
    logits, labels = np.array([-1.0, 0.5, 2.0, 3.0]), np.array([0.0, 1, 0, 1])
    times = np.array([3, 1, 2, 4])
    each = secrets._calibrated(np.repeat(logits, times), np.repeat(labels, times), np.ones(times.sum()))
    assert np.allclose(secrets._calibrated(logits, labels, times.astype(float)), each)
