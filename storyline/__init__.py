"""storyline: DataFrame operators that turn large timestamped collections into curated, explainable selections."""
