"""Operations on text corpora that stand beside the map-data engine; nothing else in the library imports this."""
