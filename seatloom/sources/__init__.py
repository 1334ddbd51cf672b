from .readers import *  # noqa: F403
