from revtide.functions import calendar, cooling, paths  # noqa: F401
