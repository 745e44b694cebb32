"""Minimum cut of a labelling problem with two labels: Dinic's blocking flows on small sparse graphs."""

from __future__ import annotations

from collections.abc import Sequence


def label(scores: Sequence[float], edges: Sequence[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut.

    A positive score is the cost of labelling the node False, a negative one that
    of labelling it True; an edge's weight is the cost of labelling its ends
    differently. Where cuts tie, the side with fewer True nodes is taken.
    """
    n = len(scores)
    if all(x > 0 for x in scores) or all(x <= 0 for x in scores):
        return [x > 0 for x in scores]
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for i, x in enumerate(scores):
        if x > 0:
            arc(source, i, x, 0.0)
        elif x < 0:
            arc(i, sink, -x, 0.0)
    for a, b, w in edges:
        arc(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        ring = [source]
        for v in ring:
            for e in out[v]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    ring.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        at = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                least = min(room[e] for e in path)
                cut = len(path)
                for k, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                    if room[e] <= 1e-9 and k < cut:
                        cut = k
                v = to[path[cut] ^ 1]
                del path[cut:]
                continue
            arcs = out[v]
            while at[v] < len(arcs):
                e = arcs[at[v]]
                if room[e] > 1e-9 and level[to[e]] == level[v] + 1:
                    break
                at[v] += 1
            if at[v] < len(arcs):
                path.append(arcs[at[v]])
                v = to[arcs[at[v]]]
            elif path:
                level[v] = -1
                v = to[path.pop() ^ 1]
            else:
                break
