"""Training-data operators: language, toxicity, quality, near copies, leaks, mixing, chat, HTML, language models, embeddings."""
