"""Operations on training corpora: filtering, deduplication, tokenisation, mixing.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""
