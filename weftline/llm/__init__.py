"""Training-data operators: one module each, registered in :mod:`weftline.llm.registry`."""
