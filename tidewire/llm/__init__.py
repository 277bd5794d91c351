"""Operations of a large-scale training-data pipeline.

Nothing outside this package imports it; it stands alone and can be deleted.
"""
