"""reelframe: media-container analytics and table operators written as Spark DataFrame transformations."""
