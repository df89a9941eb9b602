"""Greedy grouping of listings with a source lock, without a list of their pairs.

A task gets the listings of some components and the title pairs that the decision table could accept. Accepted pairs come in the
table's order: pairs without a heading first, best score first, then by both ids as text. Which pairs they are is told by numbers of
each listing, and a group that has every source takes none, so its listings are passed over instead of being paired.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa

#: What the rows of the second table are: titles of one venue, of different or unknown venues, and the forced merges.
SAME, APART, SELF, LINE = range(4)
#: How a title pair accepts: at one venue, ...
STRONG, HOUSE, PLAIN, WEAK, DEMO = range(5)
#: ... and elsewhere: anywhere, where a venue is unknown, or if both times are told as well.
ANY, UNKNOWN, TIMED = range(3)
#: Candidates that are looked at in one go.
STEP = 512


def _coded(values: pa.ChunkedArray, known: dict[str, int] | None = None) -> tuple[np.ndarray, dict[str, int]]:
    """Texts as numbers, those of ``known`` as given there; "" (also for null) is 0."""
    named = pa.chunked_array([c.fill_null("") for c in values.chunks], pa.string()).combine_chunks().dictionary_encode()
    if isinstance(named, pa.ChunkedArray):
        named = named.combine_chunks()
    known = {"": 0} if known is None else known
    table = np.array([known.setdefault(x, len(known)) for x in named.dictionary.to_pylist()], np.int64)
    return (table[named.indices.to_numpy(zero_copy_only=False)] if len(table) else np.zeros(0, np.int64)), known


def _ranks(order: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


class _Buckets:
    """Places of listings by a key, each bucket in the order of ids as text."""

    def __init__(self, key: np.ndarray, text: np.ndarray) -> None:
        self.order = np.lexsort((text, key))
        keys, start = np.unique(key[self.order], return_index=True)
        self.at = dict(zip(keys.tolist(), zip(start.tolist(), [*start[1:].tolist(), len(key)])))

    def __getitem__(self, key: int) -> np.ndarray:
        start, end = self.at.get(key, (0, 0))
        return self.order[start:end]


class _Listings:
    def __init__(self, told: pa.Table) -> None:
        plain = lambda c: told[c].to_numpy()
        flag = lambda c: np.array(told[c].fill_null(False).to_numpy(), bool)
        self.ids = plain("id")
        self.n = len(self.ids)
        self.node, self.nodes = _coded(told["node"])
        self.venue, self.venues = _coded(told["vkey"])
        self.source, names = _coded(told["source"])
        self.n_sources = len(names)
        self.m = told["m"].cast(pa.float64()).to_numpy()
        self.timed, self.demo, self.house, self.umbrella = (flag(c) for c in ("timed", "demo", "house", "umbrella"))
        at, _ = _coded(told["at"])
        by_time = sorted(_.items())
        rank = np.zeros(len(by_time), np.int64)
        rank[[code for _, code in by_time]] = np.arange(len(by_time))
        self.order = _ranks(np.lexsort((self.ids, rank[at])))
        self.text = _ranks(np.argsort(self.ids.astype("U20"), kind="stable"))
        self.by_node = _Buckets(self.node, self.text)
        self.by_place = _Buckets(self.place(self.node, self.venue), self.text)

    def place(self, node, venue):
        return node * len(self.venues) + venue


class _Groups:
    """Labels, members and sources of the groups; sources are bits in as many words as they need."""

    def __init__(self, listings: _Listings) -> None:
        n, s = listings.n, listings.source
        self.label = np.arange(n)
        self.members = [[i] for i in range(n)]
        self.words = [np.where(s // 64 == w, np.left_shift(np.uint64(1), (s % 64).astype(np.uint64)), np.uint64(0)) for w in range((listings.n_sources + 63) // 64)]
        self.every = [np.bitwise_or.reduce(w) if n else np.uint64(0) for w in self.words]
        self.full = np.zeros(n, bool)

    def merge(self, x: int, y: int) -> None:
        if len(self.members[x]) < len(self.members[y]):
            x, y = y, x
        self.label[self.members[y]] = x
        self.members[x] += self.members[y]
        self.members[y] = []
        for w in self.words:
            w[x] |= w[y]
        self.full[x] = all(w[x] == e for w, e in zip(self.words, self.every))

    def free(self, x: int, places: np.ndarray) -> np.ndarray:
        """Those of the places whose groups share no source with group x."""
        theirs = self.label[places]
        ok = (self.words[0][theirs] & self.words[0][x]) == 0
        for w in self.words[1:]:
            ok &= (w[theirs] & w[x]) == 0
        return places[ok]


class _View:
    """Listings that may follow those of a title, or of a title at a venue, in the order of their ids as text."""

    def __init__(self, told: _Listings, groups: _Groups, parts: list[tuple[np.ndarray, int]], one_venue: bool, headed: bool) -> None:
        self.told, self.groups, self.one_venue, self.headed, self.uses = told, groups, one_venue, headed, 0
        at = np.concatenate([p for p, _ in parts])
        how = np.concatenate([np.full(len(p), k, np.int8) for p, k in parts])
        if len(parts) > 1:
            order = np.argsort(told.text[at], kind="stable")
            at, how = at[order], how[order]
        self._hold(at, how)

    def _hold(self, at: np.ndarray, how: np.ndarray) -> None:
        keep = ~self.groups.full[self.groups.label[at]]
        if not self.headed:
            keep &= ~self.told.umbrella[at]
        self.at, self.how = at[keep], how[keep]
        self.text, self.order, self.m = (x[self.at] for x in (self.told.text, self.told.order, self.told.m))

    def opened(self) -> None:
        """Listings of full groups go from time to time."""
        self.uses += 1
        if self.uses % 16 == 0 and len(self.at) > 16:
            self._hold(self.at, self.how)

    def between(self, a: int, start: int, end: int) -> np.ndarray:
        """Places from ``start`` to ``end`` in this view whose pair with a is accepted."""
        t = self.told
        ok = self.order[start:end] > t.order[a]
        late = None
        if not np.isnan(t.m[a]):
            late = np.abs(self.m[start:end] - t.m[a])
            late = np.minimum(late, 1440 - late)
        at, how = self.at[start:end], self.how[start:end]
        if self.headed and not t.umbrella[a]:
            ok &= t.umbrella[at]
        if self.one_venue:
            if late is not None:
                ok &= ~(late > np.where((how == STRONG) | (how == HOUSE), 150, 90))
            if (how != STRONG).any():
                house = t.house[at] | t.house[a]
                ok &= np.where(how == HOUSE, house, np.where(how == PLAIN, ~house, True))
                ok &= (how != DEMO) | (t.demo[at] & t.timed[at] & bool(t.demo[a] & t.timed[a]))
            return at[ok]
        if late is not None:
            ok &= ~(late > 90)
        timed = (how != TIMED) | (t.timed[at] if t.timed[a] else False)
        if t.venue[a] == 0:
            return at[ok & timed]
        theirs = t.venue[at]
        elsewhere = (how == ANY) & (theirs != t.venue[a]) if not self.headed else False
        return at[ok & np.where(theirs == 0, timed, elsewhere)]


def _levels(told: _Listings, rules: pa.Table) -> dict[float, list[tuple[bool, int, int, int, int]]]:
    """Title pairs by the score with which they accept: (one venue, s, t, venue, how)."""
    levels = defaultdict(list)
    s, t = (_coded(rules[c], told.nodes)[0].tolist() for c in ("s", "t"))
    venue = _coded(rules["vkey"], told.venues)[0].tolist()
    demos = bool(told.demo.any())
    for kind, x, y, v, o, r in zip(rules["turn"].to_pylist(), s, t, venue, rules["overlap"].to_pylist(), rules["ratio"].to_pylist()):
        if kind == APART:
            if r >= 0.85:
                levels[r].append((False, x, y, 0, ANY if r >= 0.9 else UNKNOWN))
            else:
                levels[o].append((False, x, y, 0, TIMED))
        elif kind == SAME:
            if demos:
                levels[1.0].append((True, x, y, v, DEMO))
            if o >= 0.8 or r >= 0.95:
                levels[max(o, r)].append((True, x, y, v, STRONG))
            elif o >= 0.6:
                levels[o].append((True, x, y, v, HOUSE))
                levels[max(o, r)].append((True, x, y, v, PLAIN))
            elif r >= 0.75:
                levels[r].append((True, x, y, v, WEAK))
    return levels


def _follow(groups: _Groups, a: int, views: list[_View]) -> None:
    """Take the pairs of a in the order of their second ids, until its group has every source."""
    at = [0] * len(views)
    for v in views:
        v.opened()
    while True:
        ends = [int(v.text[i + STEP]) for v, i in zip(views, at) if i + STEP < len(v.at)]
        stop = [int(np.searchsorted(v.text, min(ends))) if ends else len(v.at) for v in views]
        found = [v.between(a, i, j) for v, i, j in zip(views, at, stop) if j > i]
        found = [f for f in found if len(f)]
        if found:
            places = found[0]
            if len(found) > 1:
                places = np.concatenate(found)
                places = places[np.argsort(views[0].told.text[places], kind="stable")]
            while len(places := groups.free(x := int(groups.label[a]), places)):
                groups.merge(x, int(groups.label[places[0]]))
                places = places[1:]
            if groups.full[groups.label[a]]:
                return
        if not ends:
            return
        at = stop


def _take_pairs(told: _Listings, groups: _Groups, rules: pa.Table) -> None:
    levels = _levels(told, rules)
    for headed in (False, True) if told.umbrella.any() else (False,):
        for score in sorted(levels, reverse=True):
            follows = defaultdict(list)
            for one_venue, s, t, v, how in levels[score]:
                follows[one_venue, told.place(s, v) if one_venue else s].append((told.place(t, v) if one_venue else t, how))
            first = [(told.by_place if one_venue else told.by_node)[key] for one_venue, key in follows]
            firsts = np.unique(told.text[np.concatenate(first)])
            by_text = told.by_text[firsts]
            if not headed:
                by_text = by_text[~told.umbrella[by_text]]
            views: dict[tuple[bool, int], _View] = {}
            for a in by_text.tolist():
                if groups.full[groups.label[a]]:
                    continue
                open_ = []
                for key in ((False, int(told.node[a])), (True, int(told.place(told.node[a], told.venue[a])))):
                    if key in follows:
                        if key not in views:
                            buckets = told.by_place if key[0] else told.by_node
                            views[key] = _View(told, groups, [(buckets[k], how) for k, how in follows[key]], key[0], headed)
                        if len(views[key].at):
                            open_.append(views[key])
                if open_:
                    _follow(groups, a, open_)


def grouped(listings: pa.Table, rules: pa.Table) -> pa.Table:
    """(id, cluster) of the listings of some components.

    Pairs never bring two listings of one source together, forced merges do; a line-up takes in listings that are still alone.
    """
    told = _Listings(listings)
    told.by_text = np.argsort(told.text)
    groups = _Groups(told)
    _take_pairs(told, groups, rules)
    place = {}
    forced = [(k, a, b) for k, a, b in zip(rules["turn"].to_pylist(), rules["a"].to_pylist(), rules["b"].to_pylist()) if k in (SELF, LINE)]
    if forced:
        place = dict(zip(told.ids.tolist(), range(told.n)))
    for kind, a, b in sorted(forced):
        x, y = int(groups.label[place[a]]), int(groups.label[place[b]])
        if x != y and not (kind == LINE and len(groups.members[y]) > 1):
            groups.merge(x, y)
    least = told.ids.copy()
    np.minimum.at(least, groups.label, told.ids)
    return pa.table({"id": pa.array(told.ids, pa.int64()), "cluster": pa.array(least[groups.label], pa.int64())})
