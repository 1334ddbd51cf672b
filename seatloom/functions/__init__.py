from .scalars import *  # noqa: F403
