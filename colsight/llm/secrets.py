"""Secret scans: patterns find the sure kinds, a character convolutional network judges every other candidate."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.llm.common import pieces, whole_texts
from colsight.session import materialize

#: Kinds in the order in which spans of one start are listed; ``learned`` spans come from the network.
KINDS = ("assign", "access", "hex", "learned")

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
#: A run is taken whole, so a shorter one never holds a match: the lengths may stand in the patterns.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Candidates of the network: unbroken runs of characters that keys and tokens are made of, of 12 or more with a digit
#: and of 16 or more without.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
BARE = 16

#: Characters of a candidate's begin and end, and of the context on either side, that the network sees.
INSIDE, CONTEXT = 24, 24
WINDOW = 2 * (INSIDE + CONTEXT)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Pattern matches, leftmost and not overlapping within a kind; places count code points, ends are exclusive."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, base: list[tuple[int, int, str]], bare: bool = False) -> list[tuple[int, int, bool]]:
    """(start, end, whether a pattern match overlaps) of every candidate with a digit; ``bare`` adds those without."""
    ends = [s[1] for s in base]
    reach = np.maximum.accumulate(ends) if ends else np.zeros(0, int)
    starts = np.array([s[0] for s in base])
    out = []
    for m in CANDIDATE.finditer(text):
        if (bare and len(m.group()) >= BARE) or any(c.isdigit() for c in m.group()):
            k = int(np.searchsorted(starts, m.end())) - 1 if len(starts) else -1
            out.append((m.start(), m.end(), k >= 0 and bool(reach[k] > m.start())))
    return out


def look(text: str, start: int, end: int) -> bytes:
    """What the network sees: context, the candidate's first and last characters, context; one byte a character.

    A candidate longer than twice ``INSIDE`` shows its two ends, a shorter one is padded in the middle.
    """
    half = min(INSIDE, (end - start + 1) // 2)
    rest = min(INSIDE, end - start - half)
    left = text[max(0, start - CONTEXT):start].rjust(CONTEXT, "\0") + text[start:start + half].ljust(INSIDE, "\0")
    right = text[end - rest:end].rjust(INSIDE, "\0") + text[end:end + CONTEXT].ljust(CONTEXT, "\0")
    return bytes(ord(c) if ord(c) < 128 else 127 for c in left + right)


def looks(text: str, start: int, end: int) -> list[bytes]:
    """Views that together show every character of a candidate: of a long one, stretches that overlap by half."""
    last = max(start, end - 2 * INSIDE)
    return [look(text, at, min(end, at + 2 * INSIDE)) for at in [*range(start, last, INSIDE), last]]


def _key(rng: np.random.Generator) -> str:
    """A made key: random characters of some alphabet, at times behind a short name."""
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabet = [
        digits + "abcdef", digits + "ABCDEF", lower + digits, upper + digits, lower + upper,
        lower + upper + digits, lower + upper + digits, lower + upper + digits + "-_", lower + upper + digits + "+/",
    ][rng.integers(9)]
    body = "".join(rng.choice(list(alphabet), rng.integers(BARE, 2 * INSIDE + 1)))
    if rng.random() < 0.4:
        body = "".join(rng.choice(list(lower), rng.integers(2, 5))) + rng.choice(["_", "-"]) + body
    elif rng.random() < 0.3 and not body.isalpha():
        body = body[:12] if any(c.isdigit() for c in body[:12]) else body
    return body[:2 * INSIDE]


def _harmless(words: list[str], rng: np.random.Generator) -> str:
    """A made identifier: joined words, a path, a numbered or dated name, a UUID or a number."""
    some = [words[k] for k in rng.integers(0, len(words), 6)]
    some = [w[:int(rng.integers(3, 13))] for w in some]
    number = str(rng.integers(0, 10 ** int(rng.integers(1, 9))))
    day = f"{rng.integers(1990, 2040)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}"
    made = [
        "_".join(some), "-".join(some), "/".join(some), "".join(w.capitalize() for w in some),
        "_".join(some[:3]) + "_" + number, "/".join(some[:3]) + "/" + day, "_".join(some[:3]).upper(),
        some[0] + "-" + day + "-" + number.zfill(6), some[0][:2].upper() + "-" + number.zfill(10),
        day + "T" + number.zfill(6), str(rng.integers(10**11, 10**17)), "".join(some), "".join(some[:2]),
        "-".join("".join(rng.choice(list("0123456789abcdef"), n)) for n in (8, 4, 4, 4, 12)),
        number.zfill(4) + "-" + str(rng.integers(10**4, 10**9)) + "-" + number[:3].zfill(3),
    ][rng.integers(15)]
    return made[:2 * INSIDE].ljust(12, "x") if len(made) < 12 else made[:2 * INSIDE]


def _words(rng: np.random.Generator) -> str:
    """A few made words with marks between some of them."""
    letters = rng.integers(97, 123, 32)
    letters[rng.random(32) < 0.2] = ord(" ")
    marks = rng.random(32) < 0.04
    letters[marks] = rng.choice(list(b",.:;()!?'\"=<>[]|#*"), int(marks.sum()))
    return bytes(letters.astype(np.uint8)).decode("ascii")


def made_looks(
    secret: list[bytes], harmless: list[bytes], count: int, rng: np.random.Generator
) -> tuple[list[bytes], list[bool]]:
    """``count`` made findings of either label, so that the network does not only learn the patterns' own shapes.

    Contexts are drawn from both kinds of findings, half of the keys' and a sixth of the others' from around secrets; a
    third of them are replaced by made words, for texts unlike those that have findings. Words of identifiers are those seen in harmless findings.
    """
    def inside(view: bytes) -> str:
        return view[CONTEXT:-CONTEXT].replace(b"\0", b"").decode("ascii")

    words = [w for v in harmless for w in re.findall(r"[A-Za-z]{3,}", inside(v))] or ["record"]
    out, labels = [], []
    for label, share in ((True, 1 / 2), (False, 1 / 6)):
        for _ in range(count):
            around = (secret if rng.random() < share else harmless) or secret or harmless
            view = around[rng.integers(len(around))]
            before, after = (part.replace(b"\0", b"").decode("ascii") for part in (view[:CONTEXT], view[-CONTEXT:]))
            if rng.random() < 1 / 3:
                before, after = _words(rng)[-CONTEXT + 1:] + " ", " " + _words(rng)[:CONTEXT - 1]
            body = _key(rng) if label else _harmless(words, rng)
            out.append(look(before + body + after, len(before), len(before) + len(body)))
            labels.append(label)
    return out, labels


def coded(looks: list[bytes]) -> np.ndarray:
    """Rows of characters as numbers; a candidate's own characters differ from the same ones in its context."""
    own = np.zeros(WINDOW, np.int16)
    own[CONTEXT:-CONTEXT] = 128
    return np.frombuffer(b"".join(looks), np.uint8).reshape(-1, WINDOW) + own


#: Parameters of the network in the order of its gradients.
PARTS = ("table", "kernel", "shift", "weights", "bias")

#: Findings of either label in a batch.
HALF = 64


@dataclass
class CharNet:
    """Characters to vectors, one convolution, the largest response of each filter anywhere, one logistic unit."""

    table: np.ndarray  # 256 x depth
    kernel: np.ndarray  # width x depth x filters
    shift: np.ndarray
    weights: np.ndarray
    bias: float

    @classmethod
    def fresh(cls, rng: np.random.Generator, depth: int = 8, width: int = 5, filters: int = 48) -> CharNet:
        return cls(
            rng.normal(0, 0.5, (256, depth)), rng.normal(0, (width * depth) ** -0.5, (width, depth, filters)),
            np.zeros(filters), rng.normal(0, filters**-0.5, filters), 0.0,
        )

    def _responses(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen = np.lib.stride_tricks.sliding_window_view(self.table[codes], len(self.kernel), axis=1)
        flat = np.ascontiguousarray(seen.transpose(0, 1, 3, 2)).reshape(*seen.shape[:2], -1)
        return flat, flat @ self.kernel.reshape(-1, self.kernel.shape[2]) + self.shift

    def logits(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty(len(codes))
        for at in range(0, len(codes), 512):
            top = self._responses(codes[at:at + 512])[1].max(axis=1)
            out[at:at + 512] = np.maximum(top, 0) @ self.weights + self.bias
        return out

    def gradients(self, codes: np.ndarray, labels: np.ndarray, copies: np.ndarray | None = None) -> list[np.ndarray]:
        share = np.full(len(labels), 1 / len(labels)) if copies is None else copies / copies.sum()
        flat, responses = self._responses(codes)
        best = responses.argmax(axis=1)
        top = np.take_along_axis(responses, best[:, None], axis=1)[:, 0]
        hidden = np.maximum(top, 0)
        error = (1 / (1 + np.exp(-(hidden @ self.weights + self.bias))) - labels) * share
        back = error[:, None] * self.weights * (top > 0)
        width, depth, filters = self.kernel.shape
        picked = flat[np.arange(len(codes))[:, None], best]
        kernel = np.einsum("nfk,nf->kf", picked, back).reshape(width, depth, filters)
        into = np.einsum("nf,kf->nfk", back, self.kernel.reshape(-1, filters)).reshape(len(codes), filters, width, depth)
        chars = codes[np.arange(len(codes))[:, None, None], best[:, :, None] + np.arange(width)]
        places = (chars[..., None] * depth + np.arange(depth)).ravel()
        table = np.bincount(places, into.ravel(), minlength=self.table.size).reshape(self.table.shape)
        return [table, kernel, back.sum(axis=0), hidden.T @ error, error.sum()]

    def fit(
        self, codes: np.ndarray, labels: np.ndarray, steps: int, rng: np.random.Generator, copies: np.ndarray | None = None
    ) -> None:
        """Adam over batches, half of each label; each label is gone through in a random order, again and again."""
        copies = np.ones(len(labels)) if copies is None else copies
        mean = [np.zeros_like(np.asarray(getattr(self, n), float)) for n in PARTS]
        spread = [m.copy() for m in mean]
        sides = [_passes(np.flatnonzero(labels == side), steps * HALF, rng) for side in (0, 1)]
        for step in range(1, steps + 1):
            batch = np.concatenate([s[(step - 1) * HALF:step * HALF] for s in sides])
            for k, g in enumerate(self.gradients(codes[batch], labels[batch], copies[batch])):
                mean[k] = 0.9 * mean[k] + 0.1 * g
                spread[k] = 0.999 * spread[k] + 0.001 * g * g
                change = 0.01 * mean[k] / (1 - 0.9**step) / (np.sqrt(spread[k] / (1 - 0.999**step)) + 1e-8)
                setattr(self, PARTS[k], getattr(self, PARTS[k]) - change)

    def flat(self) -> np.ndarray:
        """All parameters in a row."""
        return np.concatenate([np.ravel(getattr(self, n)) for n in PARTS])

    def filled(self, flat: np.ndarray) -> CharNet:
        """A network of the same shape with the parameters of ``flat``."""
        shapes = [np.shape(getattr(self, n)) for n in PARTS]
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        parts = [part.reshape(shape) for part, shape in zip(np.split(flat, cuts), shapes, strict=True)]
        return CharNet(*parts[:-1], float(parts[-1]))


def _passes(rows: np.ndarray, count: int, rng: np.random.Generator) -> np.ndarray:
    """``count`` of the rows: all of them in a random order, then all of them in another one, and so on."""
    return np.concatenate([rng.permutation(rows) for _ in range(-(-count // len(rows)))])[:count]


@dataclass
class Judge:
    """A network with calibrated scores, and the least score that counts as a secret."""

    net: CharNet | None
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 1.0

    def scored(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.offset, -30, 30)))

    def scores(self, codes: np.ndarray) -> np.ndarray:
        if self.net is None or not len(codes):
            return np.zeros(len(codes))
        return self.scored(self.net.logits(codes))


def _calibrated(logits: np.ndarray, labels: np.ndarray, copies: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit of labels on logits; labels are drawn in a little, as logits may part them.

    Newton steps with a small ridge, each halved until the loss falls.
    """
    bad, good = copies[labels == 1].sum(), copies[labels == 0].sum()
    aim = np.where(labels == 1, (bad + 1) / (bad + 2), 1 / (good + 2))
    x = np.stack([logits, np.ones_like(logits)], axis=1)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((copies * (np.logaddexp(0, z) - aim * z)).sum() + 5e-3 * ((w - [1, 0]) ** 2).sum())

    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (copies * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(curve, x.T @ (copies * (p - aim)) + 1e-2 * (w - [1, 0]))
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
    return float(w[0]), float(w[1])


def _reaching(scores: np.ndarray, recall: float, copies: np.ndarray) -> float:
    """The largest threshold that at least the share ``recall`` of the scores reaches."""
    order = np.argsort(-scores)
    reached = np.cumsum(copies[order])
    return float(scores[order][np.searchsorted(reached, np.ceil(recall * reached[-1]))])


#: Steps of a training, the rounds it is cut into where blocks are averaged, made findings of either label in a block, and
#: held-out secrets with fewer of which no network is trained.
STEPS, ROUNDS, MADE, LEAST = 800, 8, 6000, 3

#: Parts of a logit that held-out findings are counted by, and the logit beyond which they are counted together.
FINE, FAR = 1024, 64

#: A finding of a block: what the network sees, its label, how often it comes, and whether it is held out or made.
_FINDINGS = np.dtype([
    ("look", np.uint8, WINDOW), ("secret", np.bool_), ("copies", np.int64), ("held", np.bool_), ("made", np.bool_)
])


def block_of(
    looks: list[bytes], labels: list[bool], copies: list[int], rng: np.random.Generator, made: int = MADE
) -> np.ndarray:
    """All the labelled findings given and made ones beside them; a fourth of the findings of either label is held out.

    To the findings of either part come ``made`` ones of either label (a third as many in the held-out part), which have
    kinds of keys and identifiers that no pattern knows.
    """
    order = rng.permutation(len(labels))
    truth = np.array(labels, bool)[order]
    views, times = [looks[k] for k in order], np.array(copies, np.int64)[order]
    held = np.where(truth, np.cumsum(truth), np.cumsum(~truth)) % 4 == 0
    out = []
    for part, count, kept in ((~held, made, False), (held, made // 3, True)):
        found = np.flatnonzero(part)
        seen = [[views[k] for k in found if truth[k] == side] for side in (True, False)]
        extra, marks = made_looks(*seen, count, rng) if any(seen) else ([], [])
        rows = np.zeros(len(found) + len(extra), _FINDINGS)
        rows["look"] = np.frombuffer(b"".join([views[k] for k in found] + extra), np.uint8).reshape(-1, WINDOW)
        rows["secret"] = np.append(truth[found], np.array(marks, bool))
        rows["copies"] = np.append(times[found], np.ones(len(extra), np.int64))
        rows["held"], rows["made"] = kept, np.arange(len(rows)) >= len(found)
        out.append(rows)
    return np.concatenate(out)


def _codes(rows: np.ndarray) -> np.ndarray:
    return coded([rows["look"].tobytes()])


def fitted(net: CharNet, block: np.ndarray, steps: int, rng: np.random.Generator) -> CharNet:
    """The network after ``steps`` more on the findings of a block that are not held out."""
    rows = block[~block["held"]]
    out = net.filled(net.flat())
    if rows["secret"].any() and not rows["secret"].all():
        copies = rows["copies"].astype(float)
        out.fit(_codes(rows), rows["secret"].astype(float), steps, rng, copies)
    return out


def tallied(net: CharNet, block: np.ndarray) -> dict[str, np.ndarray]:
    """The held-out findings of a block, counted by logit in steps of 1 / ``FINE``."""
    rows = block[block["held"]]
    logits = np.floor(np.clip(net.logits(_codes(rows)), -FAR, FAR) * FINE).astype(np.int64)
    return {"made": rows["made"], "secret": rows["secret"], "logit": logits, "copies": rows["copies"]}


def judge_of(net: CharNet, tally: dict[str, np.ndarray], recall: float, precision: float) -> Judge:
    """The network with its calibration and threshold from all held-out findings.

    The threshold is the largest that reaches ``recall`` both of the held-out secrets found and of the made ones. With
    less than ``precision`` over all held-out ones at that threshold there is no network and nothing is added.
    """
    wanted, copies, logits = tally["secret"].astype(float), tally["copies"].astype(float), tally["logit"] / FINE
    judge = Judge(net, *_calibrated(logits, wanted, copies))
    scores = judge.scored(logits)
    secret = [tally["secret"] & (tally["made"] == made) for made in (False, True)]
    judge.threshold = min(_reaching(scores[at], recall, copies[at]) for at in secret if at.any())
    flagged = scores >= judge.threshold
    return judge if np.average(wanted[flagged], weights=copies[flagged]) >= precision else Judge(None)


#: (secret, held out) in the order in which a block counts its findings.
_SIDES = [(True, False), (True, True), (False, False), (False, True)]


def _found(block: np.ndarray) -> list[int]:
    """How many findings that were not made are on each of ``_SIDES``."""
    rows = block[~block["made"]]
    return [int(((rows["secret"] == secret) & (rows["held"] == held)).sum()) for secret, held in _SIDES]


def _enough(found: dict[tuple[bool, bool], int]) -> bool:
    """Whether (secret, held out) findings are as many as a training takes."""
    return found.get((True, True), 0) >= LEAST and all(
        found.get((secret, held), 0) for secret in (True, False) for held in (True, False)
    )


def train(looks: list[bytes], labels: list[bool], recall: float, precision: float, seed: int = 5) -> Judge:
    """A judge from labelled findings of one block. With fewer than ``LEAST`` held-out secrets there is no network."""
    rng = np.random.default_rng(seed)
    block = block_of(looks, labels, [1] * len(labels), rng)
    if not _enough(dict(zip(_SIDES, _found(block), strict=True))):
        return Judge(None)
    net = fitted(CharNet.fresh(rng), block, STEPS, rng)
    return judge_of(net, tallied(net, block), recall, precision)


def _blocks(labelled: DataFrame, block: int, seed: int = 5) -> DataFrame:
    """(block, found, rows): all findings dealt by ``draw`` into blocks of about ``block`` of the commoner label.

    ``labelled`` has (draw, look, secret, copies); ``rows`` are the block's findings and the made ones, ``found``
    the number of the former by label and part.
    """
    most = labelled.groupBy("secret").count().agg(F.max("count")).first()[0] or 0
    count = max(1, -(-most // block))
    dealt = labelled.withColumn("block", F.pmod("draw", F.lit(count))).repartition(count, "block")

    def gather(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("secret", "draw", "look", "copies")), strict=True))
        number = table.column("block")[0].as_py()
        rng = np.random.default_rng([seed, number])
        made = block_of([r[2] for r in rows], [r[0] for r in rows], [r[3] for r in rows], rng)
        return pa.table({
            "block": pa.array([number], pa.int64()), "found": pa.array([_found(made)], pa.list_(pa.int64())),
            "rows": pa.array([made.tobytes()], pa.binary()),
        })

    return dealt.groupBy("block").applyInArrow(gather, "block long, found array<long>, rows binary")


#: Parts of one that parameters are summed by as whole numbers, so that their order does not matter.
_UNIT = 1 << 24


def train_on_all(labelled: DataFrame, recall: float, precision: float, block: int, seed: int = 5) -> Judge:
    """A judge from all labelled findings (draw, look, secret, copies), whatever their number.

    Every block of findings trains the network in a task of its own, and in each of ``ROUNDS`` rounds the networks are
    averaged, weighed by what they were trained on; a single block needs one round. Held-out findings of all blocks are
    counted by logit, which calibration and threshold follow from. The driver sees the parameters and these counts.
    """
    blocks = materialize(_blocks(labelled, block, seed), "finding-blocks")
    number, *found = blocks.agg(F.count("*"), *(F.sum(F.col("found")[k]) for k in range(len(_SIDES)))).first()
    if not _enough({side: n or 0 for side, n in zip(_SIDES, found, strict=True)}):
        return Judge(None)
    context = blocks.sparkSession.sparkContext
    net, rounds = CharNet.fresh(np.random.default_rng(seed)), ROUNDS if number > 1 else 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for batch in batches:
            for name, rows in zip(batch.column("block"), batch.column("rows"), strict=True):
                yield name.as_py(), np.frombuffer(rows.as_buffer(), _FINDINGS)

    for turn in range(rounds):
        sent = context.broadcast(net)

        def learn(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            for name, rows in read(batches):
                size = int((~rows["held"]).sum())
                flat = fitted(sent.value, rows, STEPS // rounds, np.random.default_rng([seed, name, turn])).flat()
                parts = np.append(np.rint(flat * _UNIT).astype(np.int64) * size, size)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array(parts)], names=["place", "part"])

        sums = blocks.mapInArrow(learn, "place long, part long").groupBy("place").agg(F.sum("part").alias("part"))
        sums = sums.toArrow().sort_by("place").column("part").to_numpy().astype(float)
        net = net.filled(sums[:-1] / sums[-1] / _UNIT)
        sent.destroy()
    sent = context.broadcast(net)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in read(batches):
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in tallied(sent.value, rows).items()})

    counted = blocks.mapInArrow(count, "made boolean, secret boolean, logit long, copies long")
    tally = counted.groupBy("made", "secret", "logit").agg(F.sum("copies").alias("copies")).toArrow()
    tally = tally.sort_by([(c, "ascending") for c in ("made", "secret", "logit")])
    return judge_of(
        net, {c: tally.column(c).to_numpy() for c in ("made", "secret", "logit", "copies")}, recall, precision
    )


def scan_secrets(
    documents: DataFrame,
    recall: float = 0.95,
    precision: float = 0.9,
    block: int = 24_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    judged: str | None = None,
) -> DataFrame:
    """One row (id, spans[, doc]) per row of ``documents``; ``spans`` has (start, end, kind) in order of start, ``doc``
    the columns ``keep``. ``judged`` names a boolean column to add that says whether a network judged the candidates.

    Pattern matches always stay. Every run of 12 or more key characters with a digit, or of 16 or more without, is a
    candidate; long ones are seen in overlapping views, of which the highest score counts. Labelled findings are those that overlap a match, as secrets, and, as harmless, those of digits alone (order and card numbers and the
    like) and the longest words of documents with candidates, one for each, without digits and with a capital at most in front. Other candidates have no
    label. All labelled findings train the network and settle its threshold, in blocks of about ``block`` of either label
    that follow from a hash of id, place and characters; those that agree in all three count as one that comes several
    times. Every candidate outside the matches is then judged from itself and its context.

    A null or empty text has no spans. Repeated rows and null ids are judged one by one. A table without candidates
    trains nothing and adds nothing; an empty one gives an empty result. The table of candidates is written once, so
    texts are read once and never shuffled.
    """
    rows = documents.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"),
        *([F.struct(*(F.col(f"`{c}`") for c in keep)).alias("doc")] if keep else []),
    )
    kept = rows.schema.fields[2:]
    span = T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())
    ])
    finding = T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("look", T.BinaryType()),
        T.StructField("role", T.StringType()),
    ])
    schema = T.StructType([
        T.StructField("id", rows.schema["id"].dataType), T.StructField("base", T.ArrayType(span)),
        T.StructField("findings", T.ArrayType(finding)), *kept,
    ])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_type, finding_type = (_arrow(schema[n].dataType) for n in ("base", "findings"))
        for batch in batches:
            for piece in pieces(batch):
                found = [_scanned(x.as_py() or "") for x in piece.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array([b for b, _ in found], base_type),
                     pa.array([c for _, c in found], finding_type), *(piece.column(f.name) for f in kept)],
                    names=schema.names,
                )

    seen = materialize(whole_texts(rows).mapInArrow(scan, schema), "findings")
    labelled = seen.select("id", F.explode("findings").alias("f")).where("f.role <> 'open'").select(
        F.xxhash64("id", "f.start", "f.look").alias("draw"), "f.look", (F.col("f.role") == "secret").alias("secret")
    )
    labelled = labelled.groupBy("draw", "look", "secret").agg(F.count("*").alias("copies"))
    judge = train_on_all(materialize(labelled, "labelled-findings"), recall, precision, block)
    sent = rows.sparkSession.sparkContext.broadcast(judge)
    result = T.StructType([schema["id"], T.StructField("spans", T.ArrayType(span)), *kept])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = _arrow(result["spans"].dataType)
        for batch in batches:
            spans = _decided(batch.column("base").to_pylist(), batch.column("findings").to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(spans, spans_type), *(batch.column(f.name) for f in kept)],
                names=result.names,
            )

    out = seen.mapInArrow(decide, result)
    if judged:
        out = out.withColumn(judged, F.lit(judge.net is not None))
    return out.withColumnRenamed("id", id_col)


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with each run of overlapping spans replaced by ``mark``."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))

    def step(done: Column, span: Column) -> Column:
        between = F.substring(text, done["at"] + 1, span["start"] - done["at"])
        return F.struct(
            F.when(span["start"] >= done["at"], F.concat(done["text"], between, F.lit(mark)))
            .otherwise(done["text"]).alias("text"),
            F.greatest(done["at"], span["end"]).alias("at"),
        )

    whole = F.aggregate(spans, start, step, lambda d: F.concat(d["text"], F.substring(text, d["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _scanned(text: str) -> tuple[list[dict], list[dict]]:
    base = base_spans(text)
    found = [
        {"start": a, "end": b, "look": view,
         "role": "secret" if known else "number" if text[a:b].isdigit() else "open"}
        for a, b, known in candidates(text, base, bare=True) for view in looks(text, a, b)
    ]
    if found:
        words = [m for m in re.finditer(r"(?<!\S)\S{6,}", text) if not re.search(r"\d|(?<!^)[A-Z]", m.group())]
        words.sort(key=lambda m: m.start() - m.end())
        found += [
            {"start": m.start(), "end": m.end(), "look": look(text, *m.span()), "role": "word"}
            for m in words[:len(found)]
        ]
    return [{"start": a, "end": b, "kind": k} for a, b, k in base], found


def _decided(base: list[list[dict]], findings: list[list[dict]], judge: Judge) -> list[list[dict]]:
    judged = [(row, f) for row, fs in enumerate(findings) for f in fs if f["role"] in ("open", "number")]
    added = {
        (row, f["start"], f["end"])
        for (row, f), score in zip(judged, judge.scores(coded([f["look"] for _, f in judged])), strict=True)
        if score >= judge.threshold
    }
    out = [list(spans) for spans in base]
    for row, start, end in added:
        out[row].append({"start": start, "end": end, "kind": "learned"})
    return [sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"]))) for spans in out]
