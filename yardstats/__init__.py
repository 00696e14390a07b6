"""Sales and inventory analytics for a parts-resale business, as Spark DataFrames.

Every operator takes DataFrames and plain parameters and returns a lazy
DataFrame; nothing is collected on the way.
"""
