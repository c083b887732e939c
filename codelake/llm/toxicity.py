"""Toxicity by a subsequence string kernel machine with Nystroem landmarks.

The kernel counts common subsequences of three letters within ``SPAN`` letters, gaps weighing
``DECAY`` per letter spanned, so an insult with letters put in or left out still matches.  It is
scaled by the strings' lengths.  Strings are words without their punctuation; letters spelled one by
one count as a word; longer words are compared by windows of ``LONGEST`` letters.  A sentence's margin
is that of its worst word or phrase, a document's that of its worst sentence.

Phrases are two or three words in a row (of three letters or more; shorter ones between them don't count) that tell the
classes apart while none of them does alone.  They have a machine of their own, with the same kernel over the joined words;
it is asked about windows whose words are all like a word of some phrase (``NEAR``).

Training: a sample of at most ``per_class`` labelled documents of each class (a documented bound) comes
to the driver.  Landmarks are the words that tell the classes apart most, and the clean words most like them.
A linear machine (squared hinge loss) is trained in the whitened landmark space on the words of
labelled sentences: those of clean documents, and those of toxic documents in which a telling word
stands; hard clean words are added in rounds, and the sentences' margins set the threshold.  Since the
margin is linear in landmark kernels, and each is a sum over subsequences, it folds into one table over
letter triples; tasks score each distinct word once from the broadcast table (its size is fixed).

Edge cases: null, empty and wordless texts get the score of no evidence; null labels don't count,
repeated ones once, and ids with both labels not at all; without labels of both classes every score is 0.5 less a hair (nothing is
predicted); null ids and repeated rows are scored like others; further columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import agreed_labels, id_remainder

DECAY, SPAN, LONGEST, LETTERS = 0.6, 7, 20, 64
#: Least kernel with a word of a phrase; most words in a phrase; most phrases that are learnt, the most telling ones.
NEAR, WIDEST, PHRASES = 0.4, 3, 64
_BEGIN, _END = 62, 63
_SPELLED = re.compile(r"(?<!\S)\w(?:[ .\-_*]\w){2,}(?!\S)")
_EDGE = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
_TRIPLES = np.array([(i, j, k) for i in range(LONGEST) for j in range(i + 1, min(i + SPAN - 1, LONGEST)) for k in range(j + 1, min(i + SPAN, LONGEST))])
_WEIGHTS = DECAY ** (_TRIPLES[:, 2] - _TRIPLES[:, 0] + 1.0)
#: Scale of a string by its length: the root of the sum of squared weights of its triples.
_NORM = np.sqrt(np.array([max((_WEIGHTS[_TRIPLES[:, 2] < n] ** 2).sum(), 1e-12) for n in range(LONGEST + 1)]))


def words_of(text: str) -> list[str]:
    """Words in lower case, spelled-out ones joined; punctuation stays until they are coded."""
    text = text.lower()
    if _SPELLED.search(text):
        text += " " + " ".join(_EDGE.sub("", m[0]) for m in _SPELLED.finditer(text))
    return text.split()


def _codes(letters: np.ndarray) -> np.ndarray:
    """1 to 26 for a to z, then ten for digits, and what is left up to the marks for all others."""
    out = 37 + letters % 25
    out = np.where((letters >= 97) & (letters <= 122), letters - 96, out)
    return np.where((letters >= 48) & (letters <= 57), letters - 21, out)


def _pieces(word: str) -> list[str]:
    word, most = _EDGE.sub("", word), LONGEST - 2
    return [word[a : a + most] for a in range(0, max(1, len(word) - most // 2), most // 2)] if len(word) > most else [word]


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter codes of all pieces between two marks, their lengths, and which word each belongs to."""
    parts, owner = [], []
    for i, word in enumerate(words):
        found = _pieces(word)
        parts += found
        owner += [i] * len(found)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    rows, starts = np.repeat(np.arange(len(parts)), sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
    codes = np.zeros((len(parts), LONGEST), dtype=np.int32)
    letters = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int32)
    codes[rows, np.arange(len(letters)) - starts + 1] = _codes(letters)
    codes[:, 0], codes[np.arange(len(parts)), sizes + 1] = _BEGIN, _END
    return codes, sizes + 2, np.array(owner, dtype=np.int64)


def table_scores(table: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of weight times table entry over each row's triples, scaled by its length."""
    order = np.argsort(-lengths, kind="stable")
    codes, out = codes[order], np.zeros(len(lengths))
    reach = np.array([(lengths > k).sum() for k in range(LONGEST)])
    for (i, j, k), w in zip(_TRIPLES, _WEIGHTS, strict=True):
        n = reach[k]
        if n:
            out[:n] += w * table[(codes[:n, i] * LETTERS + codes[:n, j]) * LETTERS + codes[:n, k]]
    back = np.empty_like(out)
    back[order] = out
    return back / _NORM[np.minimum(lengths, LONGEST)]


def features(codes: np.ndarray, lengths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Explicit subsequence weights (triples, weights) of a few rows (landmarks)."""
    out = []
    for row, n in zip(codes.astype(np.int64), lengths, strict=True):
        inside = _TRIPLES[:, 2] < n
        i, j, k = _TRIPLES[inside].T
        out.append(((row[i] * LETTERS + row[j]) * LETTERS + row[k], _WEIGHTS[inside] / _NORM[n]))
    return out


def folded(words: list[str], beta: np.ndarray) -> np.ndarray:
    """One table over triples for the weighted sum of the words' kernels."""
    found = features(*coded(words)[:2])
    triples, weights = np.concatenate([t for t, _ in found]), np.concatenate([b * w for b, (_, w) in zip(beta, found, strict=True)])
    return np.bincount(triples, weights=weights, minlength=LETTERS**3)


def kernels(landmarks: list[str], words: list[str]) -> np.ndarray:
    """Kernel of each word (the largest over its pieces) with each landmark."""
    codes, lengths, owner = coded(words)
    out = np.zeros((len(words), len(landmarks)), dtype=np.float32)
    for m, (triples, weights) in enumerate(features(*coded(landmarks)[:2])):
        table = np.bincount(triples, weights=weights, minlength=LETTERS**3)
        np.maximum.at(out[:, m], owner, table_scores(table, codes, lengths).astype(np.float32))
    return out


def sequences(text: str) -> Iterator[list[str]]:
    """Each sentence's words of three letters or more in order, spelled-out ones joined."""
    for sentence in _SENTENCE.split(_SPELLED.sub(lambda m: _EDGE.sub("", m[0]), text.lower())):
        words = [w for w in (_EDGE.sub("", w) for w in sentence.split()) if 3 <= len(w) <= LONGEST - 2]
        if len(words) > 1:
            yield words


def phrase_triples(phrase: str) -> tuple[np.ndarray, np.ndarray]:
    """Triples and scaled weights of a string of any length; words are parted by a mark of their own."""
    letters = np.frombuffer(phrase.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    codes = np.r_[_BEGIN, np.where(letters == 32, 0, _codes(letters)), _END]
    triples, weights = [], []
    for far in range(2, SPAN):
        for near in range(1, far):
            n = max(0, len(codes) - far)
            triples.append((codes[:n] * LETTERS + codes[near : near + n]) * LETTERS + codes[far : far + n])
            weights.append(np.full(n, DECAY ** (far + 1.0)))
    w = np.concatenate(weights)
    return np.concatenate(triples), w / np.sqrt(max((w**2).sum(), 1e-12))


def phrase_scores(tables: np.ndarray, phrases: list[str]) -> np.ndarray:
    """Sum of weight times entry of each table (rows) over each phrase's triples."""
    out = np.zeros((len(phrases), len(tables)))
    for row, (triples, weights) in zip(out, map(phrase_triples, phrases), strict=True):
        row[:] = tables[:, triples] @ weights
    return out


@dataclass
class Phrases:
    """The machine for windows of several words."""

    parts: list[str]
    widths: list[int]
    table: np.ndarray
    bias: float

    def near(self, words: list[str]) -> np.ndarray:
        """Which words are like a word of some phrase."""
        return kernels(self.parts, words).max(axis=1) >= NEAR

    def margin(self, text: str, known: dict[str, bool]) -> float:
        """The worst window's margin; -inf without one.  ``known`` says which words are near, and learns new ones."""
        found = list(sequences(text))
        new = list({w for words in found for w in words if w not in known})
        for a in range(0, len(new), 20_000):
            known.update(zip(new[a : a + 20_000], self.near(new[a : a + 20_000]).tolist(), strict=True))
        windows = set()
        for words in found:
            close = [known[w] for w in words]
            for n in self.widths:
                windows.update(" ".join(words[a : a + n]) for a in range(len(words) - n + 1) if all(close[a : a + n]))
        return float(phrase_scores(self.table[None], sorted(windows)).max()) + self.bias if windows else -np.inf


@dataclass
class Model:
    table: np.ndarray
    bias: float
    slope: float
    phrases: Phrases | None = None

    def margins(self, words: list[str]) -> np.ndarray:
        codes, lengths, owner = coded(words)
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, owner, np.where(lengths < 5, -1.0, table_scores(self.table, codes, lengths) + self.bias))  # fewer than three letters tell nothing
        return out

    def score(self, margin: float) -> float:
        return float(1.0 / (1.0 + np.exp(-self.slope * np.clip(margin, -20.0, 20.0))))


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps over the rows inside the margin."""
    width = x.shape[1] + 1
    small = 1e-3 * np.eye(width)
    margins = lambda t: x @ t[:-1].astype(x.dtype) + t[-1]
    loss = lambda t: (cost * np.maximum(0.0, 1 - y * margins(t)) ** 2).sum() + t @ small @ t
    theta = np.zeros(width)
    now = loss(theta)
    for _ in range(steps):
        inside = np.flatnonzero(y * margins(theta) < 1)
        gram, right = small.copy(), np.zeros(width)
        for a in range(0, len(inside), 1024):  # in blocks: the driver has little memory
            rows = inside[a : a + 1024]
            part = np.c_[x[rows], np.ones(len(rows))].astype(np.float64)
            weighted = part * cost[rows, None]
            gram += weighted.T @ part
            right += weighted.T @ y[rows]
        step = np.linalg.solve(gram, right) - theta
        share = 1.0
        while share > 1e-3 and loss(theta + share * step) > now:
            share /= 2
        before, theta = now, theta + share * step
        now = loss(theta)
        if before - now < 1e-4 * before:
            break
    return theta[:-1], float(theta[-1])


def _best_cut(margins: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the least error, both classes weighing the same; the middle of the widest best gap."""
    order = np.argsort(margins, kind="stable")
    m, t = margins[order], y[order] > 0
    loss = np.cumsum(t) / max(t.sum(), 1) + ((~t).sum() - np.cumsum(~t)) / max((~t).sum(), 1)
    gaps = np.diff(m)
    if not len(gaps):
        return 0.0
    best = loss[:-1] <= loss[:-1].min() + 1e-12
    i = int(np.argmax(np.where(best, gaps, -1.0)))
    return float((m[i] + m[i + 1]) / 2)


def _bags(texts: Iterable[str]) -> tuple[list[list[np.ndarray]], dict[str, int]]:
    """Each text's sentences as numbers of their words, and the words' numbers."""
    vocabulary: dict[str, int] = {}
    bags = []
    for text in texts:
        bag = []
        for sentence in _SENTENCE.split(text):
            words = (_EDGE.sub("", w) for w in words_of(sentence))
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words if 3 <= len(w) <= LONGEST - 2]
            if ids:
                bag.append(np.array(ids, dtype=np.int32))
        bags.append(bag)
    return bags, vocabulary


def _telling(seen: list[np.ndarray], share: float) -> np.ndarray:
    """How much likelier the counts are if a word belongs to toxic documents than by chance; 0 where a tenth or more are clean."""
    clean, toxic = (c.astype(float) for c in seen)
    both = np.maximum(clean + toxic, 1.0)
    ratio = toxic * np.log(np.maximum(toxic, 1e-9) / (both * share)) + clean * np.log(np.maximum(clean, 1e-9) / np.maximum(both * (1 - share), 1e-9))
    return np.where(toxic >= 0.9 * both, ratio, 0.0)


def _before(s: np.ndarray) -> np.ndarray:
    """The word before each (one more than its number), 0 at the beginning."""
    return np.r_[0, s[:-1] + 1]


def _after(s: np.ndarray) -> np.ndarray:
    return np.r_[s[1:] + 1, 0]


def _windows(bag: list[np.ndarray], code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a text's windows of ``n`` words that all have a code, and of the words on either side."""
    size, ids, sides = int(code.max()) + 1, [], []
    for s in bag:
        if len(s) < n:
            continue
        c = code[s].astype(np.int64)
        windows = np.lib.stride_tricks.sliding_window_view(c, n)
        whole = (windows >= 0).all(axis=1)
        around = np.r_[0, s.astype(np.int64) + 1, 0]
        ids.append(windows[whole] @ (size ** np.arange(n - 1, -1, -1, dtype=np.int64)))
        sides.append((around[: len(windows)] * (len(code) + 1) + around[n + 1 :])[whole])
    none = np.zeros(0, np.int64)
    return (np.concatenate(ids), np.concatenate(sides)) if ids else (none, none)


def _telling_phrases(bags: list[list[np.ndarray]], labels: list[int], within: list[np.ndarray]) -> list[tuple[float, tuple[int, ...], int]]:
    """(ratio, words, toxic documents) of windows that tell toxic documents, by documents and by different neighbours.

    Each word of such a window stands in as many toxic documents as the window must at least, so others get no code.
    """
    share = sum(labels) / len(labels)
    places = sum(len(s) for bag, y in zip(bags, labels, strict=True) if y for s in bag)
    enough = np.log(max(1, places) / 0.01)
    least = int(np.ceil(enough / -np.log(share)))
    often = np.flatnonzero(within[1] >= least)
    if not len(often):
        return []
    code = np.full(len(within[1]), -1, dtype=np.int64)
    code[often] = np.arange(len(often))
    out = []
    for n in range(2, WIDEST + 1):
        if len(often) ** n >= 2**62:
            break
        docs, contexts = [], []
        for bag, y in zip(bags, labels, strict=True):
            if y:
                ids, sides = _windows(bag, code, n)
                docs.append(np.unique(ids))
                contexts.append(np.c_[ids, sides])
        ids, toxic = np.unique(np.concatenate(docs), return_counts=True)
        around, different = np.unique(np.unique(np.concatenate(contexts), axis=0)[:, 0], return_counts=True)  # copies of a text don't count again
        fit = (toxic >= least) & (different[np.searchsorted(around, ids)] >= least)
        ids, toxic = ids[fit], toxic[fit]
        clean = np.zeros(len(ids), np.int64)
        for bag, y in zip(bags, labels, strict=True):
            if not y and len(ids):
                own = np.unique(_windows(bag, code, n)[0])
                at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
                clean[at[ids[at] == own]] += 1
        ratio = _telling([clean, toxic], share)
        for i in np.flatnonzero(ratio > enough):
            words, rest = [], int(ids[i])
            for _ in range(n):
                rest, w = divmod(rest, len(often))
                words.append(int(often[w]))
            out.append((float(ratio[i]), tuple(reversed(words)), int(toxic[i])))
    return out


def _train_phrases(phrases: list[tuple[int, ...]], names: list[str], bags: list[list[np.ndarray]], labels: list[int], hard: int) -> Phrases | None:
    """A machine for phrases against the windows of clean documents that have a word like theirs."""
    parts, widths = sorted({names[i] for p in phrases for i in p}), sorted({len(p) for p in phrases})
    near = np.concatenate([kernels(parts, names[a : a + 20_000]).max(axis=1) >= NEAR for a in range(0, len(names), 20_000)])
    strings, others = [" ".join(names[i] for i in p) for p in phrases], set()
    for bag, y in zip(bags, labels, strict=True):
        for s in bag if not y else ():
            close = near[s]
            for n in widths:
                others.update(tuple(s[a : a + n].tolist()) for a in range(len(s) - n + 1) if close[a : a + n].any())
    plain = sorted({" ".join(names[i] for i in p) for p in others} - set(strings))
    plain = plain or parts  # no clean document has such a word: the words alone are no phrases
    table_of = lambda p: np.bincount(phrase_triples(p)[0], weights=phrase_triples(p)[1], minlength=LETTERS**3)
    like = phrase_scores(sum(map(table_of, strings))[None], plain)[:, 0]
    plain = [plain[i] for i in np.argsort(-like, kind="stable")[:hard]]
    chosen = strings + plain[:PHRASES]
    tables = np.stack([table_of(p) for p in chosen])
    values, vectors = np.linalg.eigh(phrase_scores(tables, chosen))
    keep = values > max(1e-5 * values[-1], 1e-9)
    white = vectors[:, keep] / np.sqrt(values[keep])
    x, y = phrase_scores(tables, strings + plain) @ white, np.r_[np.ones(len(strings)), -np.ones(len(plain))]
    theta, bias = _machine(x, y, np.where(y > 0, max(1.0, len(plain) / len(strings)), 1.0))
    cut = _best_cut(x @ theta + bias, y)
    return Phrases(parts, widths, (white @ theta) @ tables, bias - cut)


def train(texts: Iterable[str], labels: list[int], landmarks: int = 400, rounds: int = 4, hard: int = 4000, seed: int = 3) -> Model:
    """A model from whole labelled texts."""
    empty = Model(np.zeros(LETTERS**3), -1e-3, 1.0)
    bags, vocabulary = _bags(texts)
    if len(set(labels)) < 2:
        return empty
    names = list(vocabulary)
    # how often a word stands between different neighbours: copies of a text don't count again
    seen = [np.zeros(len(names), dtype=np.int64) for _ in (0, 1)]
    for label in (0, 1):
        own = [sentence for bag, y in zip(bags, labels, strict=True) if y == label for sentence in bag]
        before, word, after = (np.concatenate([part(s) for s in own]).astype(np.int64) if own else np.zeros(0, np.int64) for part in (_before, np.asarray, _after))
        places = np.unique((before * (len(names) + 1) + word) * (len(names) + 1) + after)
        seen[label] = np.bincount(places // (len(names) + 1) % (len(names) + 1), minlength=len(names) + 1)[: len(names)]
    # in how many documents it stands: one document, however often it repeats a word, is one witness
    within = [np.zeros(len(names), dtype=np.int64) for _ in (0, 1)]
    for bag, y in zip(bags, labels, strict=True):
        if bag:
            within[y][np.unique(np.concatenate(bag))] += 1
    # telling words stand in toxic documents so often that chance explains it for no word, by places and by documents (likelihood ratios)
    enough, clean = np.log(max(1, len(names)) / 0.01), seen[0]
    by_places, by_documents = _telling(seen, int(seen[1].sum()) / max(1, int(seen[0].sum() + seen[1].sum()))), _telling(within, sum(labels) / len(labels))
    ratio = np.minimum(by_places, by_documents)
    # a word that clean documents have too, and that toxic ones have in a telling phrase, tells nothing alone
    found = _telling_phrases(bags, labels, within)
    for _, words, n in found:
        for i in words:
            if within[0][i] and n >= 0.9 * within[1][i]:
                ratio[i] = 0.0
    phrases = []
    for _, words, _ in sorted(found, key=lambda f: (len(f[1]), -f[0], f[1])):
        inside = {words[a : a + n] for n in range(2, len(words)) for a in range(len(words) - n + 1)}
        if all(ratio[i] <= enough for i in words) and not inside & set(phrases):
            phrases.append(words)
    telling_ids = np.flatnonzero(ratio > enough)
    telling_ids = sorted(telling_ids.tolist(), key=lambda i: (-ratio[i], names[i]))
    telling = [names[i] for i in telling_ids]
    plain_ids = sorted(np.flatnonzero((clean > 0) & (ratio <= enough)).tolist(), key=names.__getitem__)
    plain = [names[i] for i in plain_ids]
    several = _train_phrases(phrases[:PHRASES], names, bags, labels, hard) if phrases else None
    if not telling or not plain:
        empty.phrases = several
        return empty
    like = Model(folded(telling, np.ones(len(telling)) / len(telling)), 0.0, 1.0).margins(plain)
    by_likeness = np.argsort(-like, kind="stable")
    chosen = telling[: landmarks // 2] + [plain[i] for i in by_likeness[: landmarks // 2]]
    values, vectors = np.linalg.eigh(kernels(chosen, chosen).astype(np.float64))
    keep = values > max(1e-5 * values[-1], 1e-9)
    white = vectors[:, keep] / np.sqrt(values[keep])
    others = np.random.default_rng(seed).permutation(len(plain))[:hard]
    used = dict.fromkeys([*by_likeness[:hard].tolist(), *others.tolist()])
    project = lambda words: kernels(chosen, words) @ white.astype(np.float32)
    x_toxic, x_plain = project(telling), project([plain[i] for i in used])
    for _ in range(rounds):
        x, y = np.r_[x_toxic, x_plain], np.r_[np.ones(len(x_toxic)), -np.ones(len(x_plain))]
        theta, bias = _machine(x, y, np.where(y > 0, 0.2 * len(x_plain) / len(x_toxic), 1.0))
        model = Model(folded(chosen, white @ theta), bias, 2.0)
        margins = model.margins(plain)
        worst = [i for i in np.argsort(-margins, kind="stable")[:2000].tolist() if margins[i] > -1 and i not in used]
        if not worst:
            break
        used.update(dict.fromkeys(worst))
        x_plain = np.r_[x_plain, project([plain[i] for i in worst])]
    # labelled sentences decide where the threshold lies: of each clean document the worst, of toxic ones those with a telling word
    known = np.full(len(names), -1.0)
    known[plain_ids], known[telling_ids] = model.margins(plain), model.margins(telling)
    tells = np.zeros(len(names), bool)
    tells[telling_ids] = True
    margins, y = [], []
    for bag, label in zip(bags, labels, strict=True):
        worst = [known[s].max() for s in bag if not label or tells[s].any()]
        if worst:
            margins.append(max(worst))
            y.append(1 if label else -1)
    cut = _best_cut(np.array(margins), np.array(y))
    return Model(model.table, model.bias - cut, 4.0, several)


def fit(documents: DataFrame, labels: DataFrame, *, label_col: str = "toxic", fold: int = 5, held_out: int = 0, per_class: int = 1000) -> Model:
    """Train on a bounded sample of the labelled documents outside the held-out fold."""
    usable = agreed_labels(labels, label_col).where(id_remainder("doc_id", fold) != held_out)
    sample = [r for y in (0, 1) for r in usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    spark = documents.sparkSession
    chosen = F.broadcast(spark.createDataFrame([(r.doc_id, r.y) for r in sample], "doc_id long, y int"))
    rows, found = documents.select("doc_id", "text").join(chosen, "doc_id").where("text is not null").orderBy("doc_id", "text").select("text", "y"), []

    def texts() -> Iterator[str]:  # one partition at a time: only the numbers of words stay
        for r in rows.toLocalIterator():
            found.append(r.y)
            yield r.text

    return train(texts(), found)


def score(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id and score; with ``keep``, all columns of the documents and toxicity_score."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def scored(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, known, close = shared.value, {}, {}
        for texts in frames:
            margins = []
            for a in range(0, len(texts), 512):
                part = [set(words_of(t)) if t else set() for t in texts.iloc[a : a + 512]]
                if len(known) > 300_000:
                    known.clear()
                new = list({w for ws in part for w in ws if w not in known})
                for b in range(0, len(new), 20_000):
                    known.update(zip(new[b : b + 20_000], model.margins(new[b : b + 20_000]).tolist(), strict=True))
                found = [max(map(known.__getitem__, ws), default=model.bias) for ws in part]
                if model.phrases is not None:
                    if len(close) > 300_000:
                        close.clear()
                    found = [max(m, model.phrases.margin(t, close)) if t else m for m, t in zip(found, texts.iloc[a : a + 512], strict=True)]
                margins += found
            yield pd.Series([model.score(m) for m in margins])

    udf = F.pandas_udf(scored, "double")
    if keep:
        return documents.withColumn("toxicity_score", udf(F.col(text_col)))
    return documents.select(F.col(id_col), udf(F.col(text_col)).alias("score"))

