"""The order in which a body's atoms are joined."""

from __future__ import annotations


def join_order(variables: list[set[str]], first: int | None = None, structural: bool = False) -> list[int]:
    """A permutation of the atoms: as written, but one that shares a variable with what is joined goes before one that does not.

    ``structural`` takes the atom that shares the most variables and adds the fewest, trying every atom as the root and
    preferring the order whose widest intermediate is narrowest.  ``first`` fixes the root."""
    n = len(variables)
    if structural and first is None:
        orders = [_grow(variables, root, True) for root in range(n)]
        return min(orders, key=lambda o: (_width(variables, o), orders.index(o)))
    return _grow(variables, 0 if first is None else first, structural)


def _grow(variables: list[set[str]], root: int, structural: bool) -> list[int]:
    order, bound, rest = [root], set(variables[root]), [k for k in range(len(variables)) if k != root]
    while rest:
        if structural:
            k = max(rest, key=lambda k: (len(variables[k] & bound), -len(variables[k] - bound), -k))
        else:
            k = next((k for k in rest if variables[k] & bound), rest[0])
        order.append(k)
        bound |= variables[k]
        rest.remove(k)
    return order


def _width(variables: list[set[str]], order: list[int]) -> int:
    """The most variables alive after any join: bound and still needed by a later atom."""
    bound, widest = set(), 0
    for n, k in enumerate(order):
        bound |= variables[k]
        later = set().union(*[variables[j] for j in order[n + 1 :]]) if n + 1 < len(order) else set()
        widest = max(widest, len(bound & later))
    return widest
