"""NumPy functions on one image at a time, for steps that depend on order or on the raster.

They are called per image by mapInArrow or applyInPandas, so parallelism is across images and memory is one
image's. What they return are tables again.
"""
