"""A loser tree over sorted runs: the k-way merge that can leave a group early."""

from __future__ import annotations

from lodestrata.functions.shipping import ship

ship(__name__)


class LoserTree:
    """Merges runs of keys; each inner node keeps the loser of its match.

    ``runs`` are sequences in ascending order of their keys. ``pop`` gives the
    index of the run and the position of the least key left; equal keys come
    by run, then position. Keys need ``<`` only.
    """

    def __init__(self, runs: list[list]):
        self.runs, self.at = runs, [0] * len(runs)
        self.k = max(1, len(runs))
        self.losers = [-1] * self.k
        for run in range(len(runs)):
            self._enter(run)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a's next key comes before run b's."""
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or (not y < x and a < b)

    def _enter(self, run: int) -> None:
        """First pass: wait at the first free node, else play on upwards."""
        node, winner = (run + self.k) // 2, run
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = winner
                return
            if self._beats(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def pop(self) -> tuple[int, int] | None:
        """The next (run, position), or None when all runs are spent."""
        winner = self.losers[0]
        if winner < 0 or self.at[winner] >= len(self.runs[winner]):
            return None
        taken = (winner, self.at[winner])
        self.at[winner] += 1
        node, climber = (winner + self.k) // 2, winner
        while node > 0:
            if self._beats(self.losers[node], climber):
                self.losers[node], climber = climber, self.losers[node]
            node //= 2
        self.losers[0] = climber
        return taken
