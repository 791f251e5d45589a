"""Ranges of the parameters of audit tasks, checked before anything runs."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from inspect import signature

# The least and most that each parameter may be, by the task that takes it.
RANGES = {
    "capture": {"max_depth": (0, 10), "max_pages": (1, 500)},
    "read_api": {"page_size": (1, 500), "max_pages": (1, 1000), "max_items": (1, 50_000)},
    "read_sitemap": {"max_urls": (1, 50_000)},
    "search_manifest": {"limit": (1, 100), "offset": (0, None), "words": (0, None), "article_words": (0, None)},
    "analyse_images": {"top": (1, 100)},
    "compare_manifests": {"limit": (1, 500)},
    "find_orphans": {"limit": (1, 500)},
}


def check(task: str, name: str, value: object) -> None:
    """Raises ValueError unless the value is a whole number in the parameter's range; pairs are checked one by one, null is none given."""
    least, most = RANGES.get(task, {}).get(name, (None, None))
    if (least is None and most is None) or value is None:
        return
    for one in value if isinstance(value, tuple) else (value,):
        if one is None:
            continue
        if isinstance(one, bool) or not isinstance(one, int):
            raise ValueError(f"{name} must be a whole number, not {one!r}")
        if (least is not None and one < least) or (most is not None and one > most):
            raise ValueError(f"{name} must be {f'at least {least}' if most is None else f'between {least} and {most}'}, not {one}")


def checked(task: Callable) -> Callable:
    """The task, with its parameters checked; names that it does not take are refused by Python."""
    takes = signature(task)

    @wraps(task)
    def run(*args, **kwargs):
        bound = takes.bind(*args, **kwargs)
        bound.apply_defaults()
        for name, value in bound.arguments.items():
            if takes.parameters[name].kind is takes.parameters[name].VAR_KEYWORD:
                for inner, given in value.items():
                    check(task.__name__, inner, given)
            else:
                check(task.__name__, name, value)
        return task(*args, **kwargs)

    return run
