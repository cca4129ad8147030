"""Operations of a pipeline for training data, one module each; nothing else in the library imports them."""
