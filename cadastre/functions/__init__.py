from cadastre.functions import buckets, numeric, strings, text  # noqa: F401
