"""The sequential leader rule as a stream: state for each live story, and a batch's index from terms to stories."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What events and time give together at most: a story that shares no term has no more.
WITHOUT_TERMS = 0.25
#: So many stories that may reach the threshold are judged one by one; of more, the commonest tokens are counted first.
FEW = 32
#: So many stories that began one after the other are one entry of the state, for each entry costs a call to the store.
BLOCK = 128
SETS = "n array<bigint>, story array<bigint>, minute array<bigint>, tokens array<array<string>>, entities array<array<string>>, events array<array<string>>"


def likeness(own: list[set], minute: int, sets: list[set], latest: int) -> float:
    """Similarity of an article and a story: title tokens, entities, events and time; developments that differ are vetoed."""
    t, e, v = (len(x & y) / len(x | y) if x and y else 0.0 for x, y in zip(own, sets, strict=True))
    if e > 0 and t < 0.32 and own[2] and sets[2] and not own[2] & sets[2]:
        return min(t, 0.25)
    hours = abs(minute - latest) / 60
    return t * 0.55 + e * 0.2 + v * 0.15 + (1.0 if hours <= 3 else 0.7 if hours <= 12 else 0.35 if hours <= 24 else 0.0) * 0.1


class Board:
    """The live stories of a key in the order in which they began, and an index from their tokens and entities to them.

    What an article shares with stories is counted along the index, the rarest tokens first. The commonest are left out, two
    fewer than could be: a story met by no other token and by no entity stays below the threshold. Of those met, only the ones
    that the counts and sizes allow to reach it are judged, so that time follows what is alike and not all that is live."""

    def __init__(self, threshold: float, keep: int):
        self.threshold, self.keep = threshold, keep
        self.ids: list[int] = []
        self.latest: list[int] = []
        self.numbers: list[dict[str, int]] = [{}, {}, {}]
        self.terms: list[list[str]] = [[], [], []]
        # of tokens, entities and events: each story's, by number; of tokens and entities also the stories of each, and for
        # each story how many it has and how many of an article's were counted
        self.sets: list[list[tuple]] = [[], [], []]
        self.index: list[list[array]] = [[], []]
        self.sizes = [np.zeros(1024, np.int64) for _ in self.index]
        self.shared = [np.zeros(1024, np.int64) for _ in self.index]

    def numbered(self, sets) -> tuple:
        """The sets of an article or story as numbers of their terms."""
        out = []
        for kind, words in enumerate(sets):
            known, terms = self.numbers[kind], self.terms[kind]
            own = dict.fromkeys(words)
            for x in own:
                if x not in known:
                    known[x] = len(terms)
                    terms.append(x)
                    if kind < 2:
                        self.index[kind].append(array("q"))
            out.append(tuple(known[x] for x in own))
        return tuple(out)

    def named(self, k: int) -> list[list[str]]:
        return [sorted(terms[x] for x in sets[k]) for terms, sets in zip(self.terms, self.sets, strict=True)]

    def begin(self, story: int, minute: int, own: tuple) -> int:
        k = len(self.ids)
        if k == len(self.sizes[0]):
            self.sizes, self.shared = ([np.concatenate([x, np.zeros_like(x)]) for x in of] for of in (self.sizes, self.shared))
        self.ids.append(story)
        self.latest.append(minute)
        for sets in self.sets:
            sets.append(())
        self.join(k, minute, own)
        return k

    def join(self, k: int, minute: int, own: tuple) -> None:
        for kind, sets in enumerate(self.sets):
            fresh = tuple(x for x in own[kind] if x not in sets[k])
            sets[k] += fresh
            if kind < 2:
                self.sizes[kind][k] += len(fresh)
                for x in fresh:
                    self.index[kind][x].append(k)
        self.latest[k] = max(self.latest[k], minute)

    def best(self, own: tuple, minute: int, newest: int) -> int | None:
        """The story that an article joins: of those at the threshold the one most like it, the first of equal ones."""
        rest = self.threshold - 0.1 - (0.15 if own[2] else 0.0) - 1e-9  # what tokens and entities must make up
        tokens = sorted(own[0], key=lambda x: len(self.index[0][x]))
        left = min(max(int(rest / 0.55 * len(tokens)) - 2, 0), len(tokens))
        lists = self._count(0, tokens[: len(tokens) - left]) + self._count(1, own[1])
        if not lists:
            return None
        met = np.concatenate(lists)
        near = met[self._at_most(met, own, left) >= rest]
        if len(near) > FEW and left:
            lists += self._count(0, tokens[len(tokens) - left :])
            near = near[self._at_most(near, own, 0) >= rest]
        for x in lists:
            self.shared[0][x] = self.shared[1][x] = 0
        top, at, mine = 0.0, None, [set(x) for x in own]
        for k in sorted(set(near.tolist())):
            if newest - self.latest[k] <= self.keep:
                score = likeness(mine, minute, [set(x[k]) for x in self.sets], self.latest[k])
                if score > top:
                    top, at = score, k
        return at if top >= self.threshold else None

    def _count(self, kind: int, terms) -> list[np.ndarray]:
        lists = [np.frombuffer(x, np.int64) for t in terms if (x := self.index[kind][t])]
        for x in lists:
            self.shared[kind][x] += 1
        return lists

    def _at_most(self, k: np.ndarray, own: tuple, left: int) -> np.ndarray:
        """What tokens and entities may give to the likeness of stories, while ``left`` tokens are not counted."""
        size = self.sizes[0][k]
        both = np.minimum(self.shared[0][k] + left, size)
        out = both / np.maximum(size + len(own[0]) - both, 1) * 0.55
        if own[1]:
            both = self.shared[1][k]
            out += both / (self.sizes[1][k] + len(own[1]) - both) * 0.2
        return out


class Leaders(StatefulProcessor):
    """Each article of a key, in order, joins the live story that it is most like, the first of equal ones, or begins one.

    A story is kept with the unions of its articles' sets and its latest time. A batch reads the live stories once, as a
    :class:`Board`, and writes the blocks of them that it has changed. A story is forgotten once its latest time lies ``keep``
    minutes before the key's newest article, so state follows what is live.
    """

    def __init__(self, threshold: float, keep: int):
        if threshold <= WITHOUT_TERMS:
            raise ValueError(f"the threshold must be above {WITHOUT_TERMS}, for stories are found by a shared term")
        self.threshold, self.keep = threshold, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stories = handle.getMapState("stories", "block bigint", SETS)
        self.seen = handle.getValueState("seen", "stories bigint, newest bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        board = Board(self.threshold, self.keep)
        began, newest = self.seen.get() if self.seen.exists() else (0, -(2**62))
        places: list[int] = []  # which of the key's stories each one of the board is
        for _, block in sorted((k, s) for k, s in self.stories.iterator()):
            for n, story, minute, *sets in zip(*block, strict=True):
                board.begin(story, minute, board.numbered(sets))
                places.append(n)
        held, changed, out = len(places), set(), []
        batch = []
        for f in rows:
            sets = map(board.numbered, zip(f["tokens"], f["entities"], f["events"], strict=True))
            batch += zip(f["seq"].tolist(), f["article_id"].tolist(), f["minute"].tolist(), sets, strict=True)
        for _, article, minute, own in sorted(batch, key=lambda r: r[:2]):
            newest = max(newest, minute)
            at = board.best(own, minute, newest)
            out.append((article, article if at is None else board.ids[at]))
            if at is not None:
                board.join(at, minute, own)
                changed.add(at)
                continue
            began += 1
            if newest - minute <= self.keep:  # else it is out of date from the start
                changed.add(board.begin(article, minute, own))
                places.append(began)
        for block, of in groupby(range(len(places)), lambda k: places[k] // BLOCK):
            every = list(of)
            live = [k for k in every if newest - board.latest[k] <= self.keep]
            if live and (len(live) < len(every) or not changed.isdisjoint(live)):
                entry = [(places[k], board.ids[k], board.latest[k], *board.named(k)) for k in live]
                self.stories.updateValue((block,), tuple(map(list, zip(*entry, strict=True))))
            elif not live and every[0] < held:
                self.stories.removeKey((block,))
        self.seen.update((began, newest))
        yield pd.DataFrame(out, columns=["article_id", "story_id"])

    def close(self) -> None:
        pass


def stream_leaders(sets: DataFrame, key: str, threshold: float = 0.43, keep_hours: int = 48) -> DataFrame:
    """(article_id, story_id) of a stream of articles (key, article_id, seq, minute, tokens, entities, events) by the
    sequential rule within each key, across micro-batches; a batch's rows are taken by ``seq``. Keys are what is worked
    side by side: a feed's topic, language or region."""
    sets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    light = sets.select(key, "article_id", "seq", "minute", "tokens", "entities", "events")
    return light.groupBy(key).transformWithStateInPandas(Leaders(threshold, keep_hours * 60), "article_id bigint, story_id bigint", "Append", "None")
