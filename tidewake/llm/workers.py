"""What a Python worker keeps between tasks.

Code of this package travels with each task by value, so module variables are new in every
task; a module registered in the worker process itself is not.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable


def kept(key: tuple, make: Callable):
    """The worker's object of this key, made on first use. Few kinds, a few objects of each."""
    place = sys.modules.setdefault("tidewake_worker_kept", types.ModuleType("tidewake_worker_kept"))
    held = place.__dict__.setdefault("held", {})
    if key not in held:
        for other in [k for k in held if k[0] == key[0]]:  # one of a kind
            del held[other]
        held[key] = make()
    return held[key]
