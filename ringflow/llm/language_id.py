"""Language identification by cross-parsing entropy.

A suffix automaton is built over labelled text of each language. A text is
parsed greedily against each automaton into longest matches; the language whose
automaton needs the fewest phrases per character wins. Parsing needs only the
automaton's transitions, kept as one table of (state, character) for each
language, whatever its script.

Passages of a text are parsed together, each as if a phrase began there. What the
passage before it leaves behind is then carried in: a passage is parsed anew from
that state, until it comes to the state that it had at the same place. So the
phrases are those of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import fold_remainder, id_text, map_rows

#: Bounded sample of labelled text: documents per language, and characters of their texts in one automaton.
TRAIN_DOCS = 60
TRAIN_CHARS = 40_000
#: Characters in all automata together; with more than 16 languages each gets an equal share. A character costs about 100 bytes in a worker.
ALL_CHARS = 640_000
#: Characters parsed in one go, characters of a passage, and passages parsed together.
STRETCH = 1 << 22
PASSAGE = 256
LANES = 1 << 14
#: Rounds in which passages are carried on together; the rest, where they don't settle, go one by one.
ROUNDS = 4
#: A state takes the bits above a character's; no character has this number.
SHIFT = 21
PAD = (1 << SHIFT) - 1


def suffix_automaton(points: Iterable[int]) -> list[dict[int, int]]:
    """Transitions character -> state of each state of the minimal automaton of all substrings; 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in points:
        cur = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return step


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def transitions(sample: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted keys (state and character), the states they lead to, and the number of states."""
    step = suffix_automaton(code_points(sample).tolist())
    ways = sorted((s << SHIFT | c, t) for s, out in enumerate(step) for c, t in out.items())
    return np.array([k for k, _ in ways], np.int64), np.array([t for _, t in ways], np.int32), len(step)


class Automaton:
    """One language's transitions, looked up for many passages at once: a table by hash, and sorted keys for what collides in it."""

    def __init__(self, keys: np.ndarray, to: np.ndarray, states: int):
        self.dead = states  # a state of its own without any way on
        bits = max(1, len(keys)).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        slot, first = np.unique(self._slot(keys), return_index=True)
        self.key, self.to = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.dead, np.int32)
        self.key[slot], self.to[slot] = keys[first], to[first]
        other = np.ones(len(keys), bool)
        other[first] = False
        self.rest_key, self.rest_to = keys[other], to[other]
        self.ways = keys, to
        self.by_key: dict[int, int] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def follow(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        key = (state.astype(np.int64) << SHIFT) | c
        slot = self._slot(key)
        out = self.to[slot]
        miss = np.flatnonzero(self.key[slot] != key)
        out[miss] = self.dead
        if len(self.rest_key):
            wanted = key[miss]
            at = np.minimum(np.searchsorted(self.rest_key, wanted), len(self.rest_key) - 1)
            found = self.rest_key[at] == wanted
            out[miss[found]] = self.rest_to[at[found]]
        return out

    def advance(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase begins with this character."""
        nxt = self.follow(state, c)
        fresh = nxt == self.dead
        at = np.flatnonzero(fresh)
        if len(at):
            nxt[at] = self.follow(np.zeros(len(at), np.int32), c[at])
        return nxt, fresh & (c != PAD)

    def parse(self, block: np.ndarray, entry: int, joined: np.ndarray) -> tuple[np.ndarray, int]:
        """Phrases that begin in each passage of ``block`` [place, passage], and the state at its end.

        ``entry`` is the state in which the first passage is reached; ``joined`` tells
        of each passage whether it goes on where the one before it ends.
        """
        n = block.shape[1]
        states, begins = np.empty(block.shape, np.int32), np.empty(block.shape, bool)
        state = np.full(n, self.dead, np.int32)
        state[0] = entry
        for t, c in enumerate(block):
            state, begins[t] = self.advance(state, c)
            states[t] = state
        todo, rounds = np.flatnonzero(joined), 0
        todo = todo[todo > 0]
        come = states[-1, todo - 1]
        while len(todo) and rounds < ROUNDS:
            live, state = todo, come
            for t, c in enumerate(block):
                state, fresh = self.advance(state, c[live])
                begins[t, live] = fresh
                changed = states[t, live] != state
                live, state = live[changed], state[changed]
                if not len(live):
                    break
                states[t, live] = state
            nxt = live + 1
            go = nxt < n
            go[go] = joined[nxt[go]]
            todo, come, rounds = nxt[go], state[go], rounds + 1
        self._one_by_one(block, joined, states, begins, todo.tolist(), come.tolist())
        return begins.sum(axis=0), int(states[-1, -1])

    def _one_by_one(self, block: np.ndarray, joined: np.ndarray, states: np.ndarray, begins: np.ndarray, todo: list[int], come: list[int]) -> None:
        if todo and not self.by_key:
            self.by_key = dict(zip(self.ways[0].tolist(), self.ways[1].tolist(), strict=True))
        done = -1
        for lane, state in zip(todo, come, strict=True):
            while lane > done:
                done = lane
                settled = False
                own, chars = states[:, lane].tolist(), block[:, lane].tolist()
                for t, c in enumerate(chars):
                    nxt = self.by_key.get(state << SHIFT | c, self.dead)
                    fresh = nxt == self.dead
                    state = self.by_key.get(c, self.dead) if fresh else nxt
                    begins[t, lane] = fresh and c != PAD
                    if settled := state == own[t]:
                        break
                    states[t, lane] = state
                if settled or lane + 1 >= len(joined) or not joined[lane + 1]:
                    break
                lane += 1


class CrossParser:
    """Automata of all languages, from ``transitions`` of their samples."""

    def __init__(self, tables: dict[str, tuple[np.ndarray, np.ndarray, int]]):
        self.langs = sorted(tables)
        self.automata = [Automaton(*tables[lang]) for lang in self.langs]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases needed per text and language: the longest matches, one after the other; a character that no sample holds is one."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        group: list[tuple[int, np.ndarray]] = []
        held, entries = 0, [a.dead for a in self.automata]
        for k, text in enumerate(texts):
            for at in range(0, len(text), STRETCH):
                piece = code_points(text[at : at + STRETCH])
                if group and (at or held + len(piece) > STRETCH):
                    exits = self._parse(group, entries, out)
                    group, held, entries = [], 0, exits if at else [a.dead for a in self.automata]
                group.append((k, piece))
                held += len(piece)
        if group:
            self._parse(group, entries, out)
        return out

    def _parse(self, group: list[tuple[int, np.ndarray]], entries: list[int], out: np.ndarray) -> list[int]:
        """Add the phrases of pieces of different texts to ``out``; the states after the last piece."""
        cuts = [-(-len(p) // PASSAGE) for _, p in group]
        owner = np.repeat([k for k, _ in group], cuts)
        joined = np.r_[False, owner[1:] == owner[:-1]]
        lanes = np.full((len(owner), PASSAGE), PAD, np.int64)
        row = 0
        for (_, p), n in zip(group, cuts, strict=True):
            lanes[row : row + n].reshape(-1)[: len(p)] = p
            row += n
        states = list(entries)
        for at in range(0, len(lanes), LANES):
            block = np.ascontiguousarray(lanes[at : at + LANES].T)
            for j, automaton in enumerate(self.automata):
                entry = states[j] if not at or joined[at] else automaton.dead
                counts, states[j] = automaton.parse(block, entry, joined[at : at + LANES])
                out[:, j] += np.bincount(owner[at : at + LANES], weights=counts, minlength=len(out)).astype(np.int64)
        return states


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def training_samples(labelled: DataFrame, docs_per_lang: int = TRAIN_DOCS, chars: int = TRAIN_CHARS, all_chars: int = ALL_CHARS) -> dict[str, str]:
    """lang -> sample of text; at most ``docs_per_lang`` passages and ``chars`` characters for each language, and ``all_chars`` in all."""
    each = max(1, chars // docs_per_lang)
    at = 1 + F.pmod(F.xxhash64("text", "doc_id"), F.greatest(F.length("text") - each + 1, F.lit(1)))  # a passage from anywhere in its text
    rows = (
        labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .select("lang", F.struct(F.xxhash64("doc_id", "text").alias("h"), F.substr("text", at.cast("int"), F.lit(each)).alias("piece")).alias("x"))
        .groupBy("lang", (F.pmod(F.col("x.h"), F.lit(docs_per_lang))).alias("slot"))
        .agg(F.min("x").alias("x"))
        .select("lang", "slot", "x.piece")
        .orderBy("lang", "slot")
        .collect()
    )
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["lang"], []).append(r["piece"].lower())
    share = min(chars, all_chars // max(1, len(out)))  # of every passage alike
    return {lang: "\n".join(p[: max(1, share // len(pieces))] for p in pieces)[:share] for lang, pieces in out.items()}


def identify_languages(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, phrases, chars.

    ``labelled`` has doc_id, text and lang and alone is learned from: per language
    a sample of TRAIN_DOCS passages and TRAIN_CHARS characters at most, and
    ALL_CHARS in all, chosen by hash, so what is broadcast doesn't grow with the
    corpus nor with the number of languages. ``score`` is
    1 - best / second best number of phrases, scaled into 0 to 1 (1 if only one
    language was learned). A null text or one without a letter is ``und`` with
    score 0; so is every text if nothing could be learned. Ties go to the
    language first in alphabetical order. Null and repeated ids and repeated rows
    are kept; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast({lang: transitions(text) for lang, text in training_samples(labelled).items()})

    def make():
        parser = CrossParser(shared.value) if shared.value else None

        def work(rows: dict) -> dict:
            texts = [t.lower() if t is not None and has_letter(t) else None for t in rows["text"]]
            live = [i for i, t in enumerate(texts) if t is not None and parser]
            n = len(texts)
            pred, score, best, chars = ["und"] * n, [0.0] * n, [0] * n, [0] * n
            counts = parser.phrases([texts[i] for i in live]) if live else []
            for i, own in zip(live, counts, strict=True):
                order = np.argsort(own, kind="stable")
                first, second = int(own[order[0]]), int(own[order[1]]) if len(own) > 1 else 0
                pred[i], best[i], chars[i] = parser.langs[order[0]], first, len(texts[i])
                score[i] = 1 - first / second if second else 1.0
            return {"doc_id": rows["doc_id"], "lang_pred": pred, "score": score, "phrases": best, "chars": chars}

        return work

    return map_rows(id_text(docs, id_col, text_col), make, "doc_id long, lang_pred string, score double, phrases long, chars long")


def held_out(doc_id):
    return fold_remainder(doc_id, 3) == 1
