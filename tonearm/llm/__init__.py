"""Operations of a training-data pipeline on DataFrames; nothing else in the library imports this subpackage."""
