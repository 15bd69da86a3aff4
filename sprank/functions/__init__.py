from sprank.functions import ranking, text  # noqa: F401
