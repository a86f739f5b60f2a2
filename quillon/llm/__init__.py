"""Training-data operators (deduplication, decontamination, packing, scoring).

Nothing outside this subpackage imports it; ``quillon.llm.entry`` lists its
queries for the driver.
"""
