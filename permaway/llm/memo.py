"""What a worker remembers of words it has met."""

from __future__ import annotations

from collections.abc import Callable, Hashable


class Memo:
    """Values of keys in two generations of at most `most` keys, or those of one call: what is asked again outlives the next."""

    def __init__(self, make: Callable[[list], list], most: int) -> None:
        self.make, self.most = make, most
        self.young: dict[Hashable, object] = {}
        self.old: dict[Hashable, object] = {}

    def values(self, keys: set) -> dict:
        """A mapping with all of the keys; those unknown are made together."""
        missing = keys.difference(self.young)
        if missing:
            if len(self.young) + len(missing) > self.most:
                self.old, self.young, missing = self.young, {}, keys
            met = [x for x in missing if x in self.old]
            self.young.update((x, self.old[x]) for x in met)
            fresh = list(missing.difference(met))
            self.young.update(zip(fresh, self.make(fresh), strict=True))
        return self.young
